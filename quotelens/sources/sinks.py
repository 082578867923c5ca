"""Writers and report projections."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASTER_EXPORT = {
    "item_id": "표준품목ID", "category": "품목분류", "item_name": "품명", "spec": "규격", "unit": "단위",
    "price_min": "단가_최저(원)", "price_avg": "단가_평균(원)", "price_max": "단가_최고(원)",
    "data_count": "데이터건수", "main_maker": "주요메이커", "latest_quote_date": "최근견적일",
    "source_vendors": "출처공급사", "entry_date": "데이터입력일자",
}
RAW_EXPORT = {
    "id": "ID", "vendor": "공급사", "quote_no": "견적번호", "quote_date": "견적일", "project": "공사명",
    "unit_name": "단위장비명", "category": "품목분류", "item_name": "품명", "spec": "규격", "unit": "단위",
    "quantity": "수량", "unit_price": "단가(원)", "amount": "금액(원)", "maker": "메이커",
    "entry_date": "데이터입력일자",
}
COMPARE_EXPORT = {
    "unit_name": "단위장비명", "item_name": "품명", "spec": "규격", "unit": "단위", "quantity": "수량",
    "unit_price": "견적단가(원)", "std_price_min": "표준단가_최저(원)", "std_price_avg": "표준단가_평균(원)",
    "std_price_max": "표준단가_최고(원)", "deviation_pct": "차이율(%)", "verdict": "판정",
    "matched_name": "매핑품명", "similarity_pct": "유사도(%)",
}
REVIEW_EXPORT = {
    "item_name": "품명", "spec": "규격", "unit": "단위", "quantity": "수량", "quote_price": "견적단가",
    "db_mark": "DB존재", "standard_price": "표준단가", "direction": "표준단가_방향", "market_price": "KPI시장가",
    "discount": "할인율(%)", "discount_price": "할인율적용가", "recommended": "시스템추천",
    "basis": "검토근거", "final_price": "최종검토가",
}
# What review_records reads.
REVIEW_INPUT = [
    "unit_name", "item_name", "spec", "unit", "quantity", "quote_price", "final_price", "basis", "standard_price", "market_price",
    "discount",
]


def export(df: DataFrame, headers: Mapping[str, str]) -> DataFrame:
    """Report columns in order under their printed headers."""
    return df.select(*[F.col(c).alias(h) for c, h in headers.items()])


def write_csv(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def review_records(review: DataFrame, source_file: str, today: Column) -> DataFrame:
    """Confirmed review lines as stored records, stamped with date and source file."""
    def number(name: str, kind: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast(kind).alias(name)

    qty = F.coalesce(F.col("quantity").cast("double"), F.lit(0.0))
    return review.select(
        today.alias("review_date"), F.lit(source_file).alias("source_file"),
        F.coalesce("unit_name", F.lit("")).alias("unit_name"), "item_name",
        F.coalesce("spec", F.lit("")).alias("spec"), F.coalesce("unit", F.lit("")).alias("unit"),
        F.when(qty == 0, F.lit(1.0)).otherwise(qty).alias("quantity"),
        F.col("quote_price").cast("bigint").alias("quote_price"),
        F.col("final_price").cast("bigint").alias("final_price"), "basis",
        number("standard_price", "bigint"), number("market_price", "bigint"), number("discount", "double"),
    )
