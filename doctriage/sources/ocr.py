"""Text from OCR responses: line blocks and the first-page rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

BLOCKS = T.ArrayType(T.StructType([T.StructField("BlockType", T.StringType()),
                                   T.StructField("Text", T.StringType())]))
RESPONSE = T.StructType([T.StructField("doc_id", T.LongType()),
                         T.StructField("page_no", T.LongType()),
                         T.StructField("Blocks", BLOCKS)])


def assemble_lines(blocks: Column | str, lower: bool = False,
                   lead_space: bool = False) -> Column:
    """The text of the LINE blocks in order, each followed by a space."""
    blocks = F.col(blocks) if isinstance(blocks, str) else blocks
    lines = F.filter(blocks, lambda b: b["BlockType"] == "LINE")
    text = F.array_join(F.transform(
        lines, lambda b: F.concat(F.coalesce(b["Text"], F.lit("")), F.lit(" "))), "")
    text = F.concat(F.lit(" "), text) if lead_space else text
    return F.lower(text) if lower else text


def first_page(pages: DataFrame, doc: str, page_no: str, text: str) -> DataFrame:
    """The text of each document's lowest page number; partial minimum, one shuffle."""
    return pages.groupBy(doc).agg(F.min_by(text, page_no).alias(text))


def numbered_first_page(pages: DataFrame, page_no: str = "page_no") -> DataFrame:
    """As ``first_page`` where pages count from one: a pushed-down filter."""
    return pages.filter(F.col(page_no) == 1)


PAGED_RESPONSE = T.StructType([T.StructField("Blocks", T.ArrayType(T.StructType([
    T.StructField("BlockType", T.StringType()), T.StructField("Text", T.StringType()),
    T.StructField("Page", T.LongType())])))])


def first_page_blocks(content: Column) -> Column:
    """Blocks of the first page from a JSON response's bytes; blocks without a page are on it.

    Null where the content is no response.
    """
    blocks = F.from_json(F.decode(content, "UTF-8"), PAGED_RESPONSE)["Blocks"]
    return F.filter(blocks, lambda b: F.coalesce(b["Page"], F.lit(1)) == 1)
