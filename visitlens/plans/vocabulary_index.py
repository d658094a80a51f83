"""N3 step by step: a stored vocabulary that only new labels are compared with.

The index holds, batch by batch, the labels seen, their segments (``similarity_join``)
and the pairs of keys that match.  A new batch drops known labels; the segments of its
new keys meet the stored ones and each other, never old with old.  Proposals follow from
all labels and pairs, as in a full run.  A batch is written beside the index and moved
in as a whole, so one that fails leaves no trace.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.constants import SIMILARITY_THRESHOLD
from visitlens.operators import similarity_join as S
from visitlens.session import checkpoint_dir, list_paths, replace_path

_TABLES = {
    "labels": "value string, ts string, n int",
    "own": "ts_a string, n_a int, x_a long, y_a long, to int, at int, segment string",
    "other": "ts_b string, n_b int, x_b long, y_b long, `from` int, i int, text string",
    "pairs": "ts_a string, n_a int, ts_b string, n_b int, lcs int, score double",
}


def read_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The index's tables over all batches, empty before the first."""
    batches = list_paths(spark, f"{path.rstrip('/')}/batch=*")
    return {t: spark.read.schema(schema).parquet(*[f"{b}/{t}" for b in batches]) if batches else spark.createDataFrame([], schema)
            for t, schema in _TABLES.items()}


def add_labels(values: DataFrame, path: str, col: str = "value", threshold: int = SIMILARITY_THRESHOLD) -> int:
    """Take the labels of ``values`` into the index; returns how many were new."""
    spark = values.sparkSession
    checkpoint_dir(spark)
    known = read_index(spark, path)
    labels = S.label_keys(values, col).join(known["labels"].select("value"), "value", "left_anti").select("value", "ts", "n").checkpoint()
    count = labels.count()
    if not count:
        return 0
    keys = labels.select("ts", "n").distinct().join(known["labels"].select("ts").distinct(), "ts", "left_anti")
    own, other = (side.checkpoint() for side in S.segment_index(keys, threshold))
    met = [S.meet(own, other), S.meet(own, known["other"]), S.meet(known["own"], other)]
    close = reduce(DataFrame.unionByName, [S.close_pairs(m, threshold) for m in met])
    tables = {"labels": labels, "own": own, "other": other, "pairs": S.matching(close.distinct(), threshold)}
    number = len(list_paths(spark, f"{path.rstrip('/')}/batch=*"))
    beside = f"{path.rstrip('/')}/new-{uuid.uuid4().hex[:12]}"
    for name, schema in _TABLES.items():
        tables[name].select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in known[name].schema]).write.parquet(f"{beside}/{name}")
    replace_path(spark, beside, f"{path.rstrip('/')}/batch={number:06d}")
    return count


def proposals(spark: SparkSession, path: str, threshold: int = SIMILARITY_THRESHOLD) -> DataFrame:
    """N2 over the whole index: (variant, canonical, similarity) in proposal order."""
    known = read_index(spark, path)
    return S.clustered(known["labels"], known["pairs"], threshold)["proposals"].orderBy("canonical", F.col("similarity").desc(), "variant")
