"""How many files the substring query's tables are written in, whatever the number of shuffle partitions."""

from cadenza.llm import queries, subdedup
from odd_rows import TINY


def test_substring_dedup_writes_few_files(spark, monkeypatch):
    files, stored = [], subdedup.stored

    def counted(df, name):
        out = stored(df, name)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(subdedup, "stored", counted)
    cores = spark.sparkContext.defaultParallelism
    conf = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert queries.op2_substring_dedup(spark, TINY).rdd.getNumPartitions() == cores
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(files) == 1 and files[0] <= 4 * cores
