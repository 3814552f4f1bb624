import random

from pyspark.sql import functions as F

from tierlabel.llm.chat import CONTROL, format_conversations, loss_text

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, source string"


def test_hostile_texts_come_back(spark):
    r = random.Random(7)
    bits = [*CONTROL, "\\", "\\\\", "<", "s>", "[", "INST]", "/", "*", "é", "😀", "\n", "", " ", "$1", "ok", "</s", "[/INST"]
    rows = [
        (c, t, r.choice(["user", "assistant", "system", "a<s>b", "\\", None, ""]), "".join(r.choices(bits, k=r.randrange(7))) or None, "x", "x")
        for c in range(60)
        for t in range(r.randrange(1, 6))
    ]
    rows += [(None, 1, "user", "no id", "x", "x"), (61, None, "user", "second", "x", "x"), (61, None, "assistant", "first", "x", "x")]
    rows += [(62, 1, "user", "twice", "x", "x")] * 2 + [(63, i, "assistant", "[INST]" * 50, "x", "x") for i in range(300)]
    out = format_conversations(spark.createDataFrame(rows, SCHEMA).repartition(4))
    got = {x["conv_id"]: x for x in out.withColumn("loss", loss_text(F.col("turns"))).collect()}
    assert len(got) == len({x[0] for x in rows})
    for c, x in got.items():
        own = sorted(((t is not None, t or 0, role or "", text or "") for i, t, role, text, *_ in rows if i == c))
        assert [(t["role"], t["text"]) for t in x["turns"]] == [o[2:] for o in own]
        assert x["loss"] == "".join(o[3] for o in own if o[2] == "assistant")
        # no control string but the template's own three per turn
        assert sum(x["formatted"].count(c) for c in CONTROL) == 3 * len(own)


def test_plain_texts_are_not_touched(spark):
    rows = [(1, 0, "user", "hi \\ there", "x", "x"), (1, 1, "assistant", "hello", "x", "x")]
    out = format_conversations(spark.createDataFrame(rows, SCHEMA)).first()
    assert out["formatted"] == "<s>user[INST]hi \\ there</s><s>assistant[/INST]hello</s>"


def test_empty_and_native(spark):
    out = format_conversations(spark.createDataFrame([], SCHEMA))
    assert out.collect() == [] and not any(x in out._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Arrow", "Pandas"))
