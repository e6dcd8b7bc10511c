"""What the driver gives back between the steps of a long chain of plans."""

import sys

import pytest
from cadenza.llm import _spark, toxicity


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="the C library of Linux")
def test_the_jvm_trims_its_native_memory(spark):
    said = _spark.give_back_driver(spark)
    assert said is not None and said.startswith("Trim native heap")


def test_each_stored_step_and_each_training_gives_back(spark, monkeypatch):
    calls = []
    for module in (_spark, toxicity):
        monkeypatch.setattr(module, "give_back_driver", lambda session: calls.append(session))
    assert _spark.stored(spark.range(3), "three").count() == 3 and len(calls) == 1
    docs = spark.createDataFrame([(k, "w") for k in range(9)], "doc_id long, text string")
    toxicity.train(docs, spark.createDataFrame([(k, k % 2) for k in range(9)], "doc_id long, toxic int"))
    assert len(calls) == 2


def test_without_the_command_nothing_is_lost(spark, monkeypatch):
    class Old:
        class sparkContext:
            @property
            def _gateway(self):
                raise _spark.Py4JError("no such command")

    old = Old()
    old.sparkContext = Old.sparkContext()
    assert _spark.give_back_driver(old) is None
