"""Supplier quotation price analytics as Spark DataFrame operators."""
