"""SimHash near-duplicates: exact Hamming links by pigeonring filtering, and their connected components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastrel.llm.common import shuffled, spread_join, written
from rastrel.llm.components import connected_components
from rastrel.llm.fingerprints import fingerprint
from rastrel.llm.nearcopies import deduplicated
from rastrel.llm.pigeonring import _flips, further_bits, hamming_links

#: A fingerprint or a component with more than one in so many rows is hot; there are no more than so many of them.
HOT = 1000
__all__ = ["_flips", "deduplicated", "further_bits", "hamming_links", "simhash_components", "with_fingerprints"]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprints(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The key columns and the fingerprint `fp` (as a signed long) of each row; a null text counts as one without words."""
    schema = docs.select(*keys).schema.add("fp", "long")
    kept = [f.name for f in schema][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary())
            made = pa.array((_signed(fingerprint(t.as_py())) for t in texts), pa.int64(), size=len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], [*kept, "fp"])

    return docs.select(*keys, F.col(text).alias("__text")).mapInArrow(run, schema)


def simhash_components(docs: DataFrame, keys: list[str], order: str = "doc_id", text: str = "text") -> DataFrame:
    """The key columns, `fp`, and `component_id`: the least `order` value among rows whose fingerprints are reachable
    by links of at most three bits, the row itself included.

    Equal texts share a fingerprint and count once in the link search, however many they are. A null or empty text has
    fingerprint zero and is linked like any other; a null `order` is passed over by the least, and gives null where all
    are null. Repeated rows stay. An empty table gives an empty table.
    """
    marked = written(with_fingerprints(docs, keys, text), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    total = distinct.agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("rows")).first()
    parts = connected_components(hamming_links(distinct.select("fp"), further_bits(total["texts"])))
    labelled = distinct.join(shuffled(parts.withColumnRenamed("node", "fp")), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    names = labelled.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    large = names.where(F.col("n") * HOT > total["texts"])
    by_fp = spread_join(labelled.select("fp", "component"), shuffled(names.select("component", "component_id")), "component", large).select("fp", "component_id")
    often = distinct.where(F.col("n") * HOT > (total["rows"] or 0))
    return spread_join(marked, shuffled(by_fp), "fp", often).select(*marked.columns, "component_id")
