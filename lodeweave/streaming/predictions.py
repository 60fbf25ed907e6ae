"""Predictions over arriving triples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.operators.measures import predicted_pairs


def stream_predictions(triples: DataFrame, rules: DataFrame, known: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends to ``path`` what each batch of ``triples`` (a stream of ``s``, ``p``, ``o``) lets the rules
    newly predict: heads of bodies over known and arrived triples that neither had before.

    Every batch is written to ``path``/facts and ``path``/predictions under its number, so that a batch that is run again
    replaces its own rows.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        from lodeweave.plans.lineage import cut

        new = cut(batch.select("s", "p", "o").distinct(), "arrived")
        before = known.select("s", "p", "o")
        for n in range(number):
            before = before.unionByName(spark.read.schema("s long, p long, o long").parquet(f"{path}/facts/batch={n}"))
        touched = new.select("p").distinct()
        atoms = rules.select("rule_id", F.explode("body").alias("a")).select("rule_id", F.col("a.p").alias("p"))
        active = rules.join(atoms.join(touched, "p", "left_semi").select("rule_id").distinct(), "rule_id", "left_semi")
        every = before.unionByName(new).distinct()
        found = predicted_pairs(active, every, True).join(every, ["s", "p", "o"], "left_anti")
        old = predicted_pairs(active, before.distinct(), True)
        found = found.join(old, ["rule_id", "s", "p", "o"], "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/facts/batch={number}")
        found.write.mode("overwrite").parquet(f"{path}/predictions/batch={number}")

    return triples.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
