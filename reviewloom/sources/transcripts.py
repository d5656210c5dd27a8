"""Transcript text files."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_transcript(entries: DataFrame, path: str) -> None:
    """Write entries as text, one after the other in conversation order.

    Rows are range-partitioned over all conversations together, so one endless
    conversation spreads over many files; read in name order they join up.
    """
    (entries.repartitionByRange("conv_id", "pair_no").sortWithinPartitions("conv_id", "pair_no")
     .select("entry").write.mode("overwrite").text(path))
