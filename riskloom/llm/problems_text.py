"""Queries of problems 7, 8 and 9: documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import materialise, table
from .language import detect_languages, fit
from .leakage import leak_spans, leaked_items, remove_leaks
from .packing import Limits, fullness, pack, token_sizes

# Containers of one capacity, only longer texts cut: a loss limit below the token limit would cut shorter ones.
P7 = Limits(tokens=2_048, segments=64, loss=2_048)
# Instruction data: three limits that each bind on part of the containers; what exceeds one of them alone is cut.
P7_INSTRUCTION = Limits(tokens=2_048, segments=8, loss=1_920)


def _sizes(spark, sf_dir):
    return materialise(token_sizes(table(spark, sf_dir, "documents"), "doc_id", "text"), "sizes")  # each text is tokenised once


def p7_containers(spark, sf_dir):
    return pack(_sizes(spark, sf_dir), "doc_id", "n_tokens", "n_head", P7)


def p7_instruction(spark, sf_dir):
    """Under limits on tokens, segments and loss-bearing tokens that all bind."""
    return pack(_sizes(spark, sf_dir), "doc_id", "n_tokens", "n_head", P7_INSTRUCTION)


def p7_fullness(spark, sf_dir):
    """For both sets of limits: containers, the least number possible, and how far each limit is used."""
    sizes, out = _sizes(spark, sf_dir), None
    for name, limits in (("containers", P7), ("instruction", P7_INSTRUCTION)):
        row = fullness(pack(sizes, "doc_id", "n_tokens", "n_head", limits), limits).withColumn("limits", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def p8_found(spark, sf_dir):
    found = leaked_items(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "item_text")
    return found.select("doc_id", "item_id").distinct()


def p8_spans(spark, sf_dir):
    return leak_spans(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "item_text")


def p8_clean(spark, sf_dir):
    """Every document without the spans of evaluation items."""
    return remove_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "item_text")


def p9_segments(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return detect_languages(docs, "doc_id", "text", "lang", fit(docs, "doc_id", "text", "lang"))


def p9_found(spark, sf_dir):
    found = p9_segments(spark, sf_dir)
    return found.where("CASE WHEN seg_no = 0 THEN label IS NULL OR label <> lang ELSE langs > 1 END").select("doc_id", "seg_no", "lang")


QUERIES = {"p7_containers": p7_containers, "p7_instruction": p7_instruction, "p7_fullness": p7_fullness, "p8_found": p8_found, "p8_spans": p8_spans, "p8_clean": p8_clean, "p9_found": p9_found}
ORACLE: dict[str, str] = {}
