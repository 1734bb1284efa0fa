"""Bulk invoice-document processing as Spark DataFrame operators."""
