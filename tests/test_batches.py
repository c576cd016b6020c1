"""What Python steps hold at once is bounded by bytes, whatever the rows of a batch."""

import json

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from turnmill import batches as B
from turnmill.operators import prepare as P
from turnmill.operators import render as R
from turnmill.operators import tools as T
from turnmill.sources.jsonl import convert_texts

LONG, ROWS = 5000, 400


class Watched:
    """A character tokenizer that fails where it is given much at once."""

    def encode_batch(self, texts):
        assert sum(map(len, texts)) <= B.PIECE, "too much at once"
        return [R.CharTokenizer().encode(t) for t in texts]


class Held(list):
    alive = 0

    def __init__(self, *a):
        super().__init__(*a)
        Held.alive += 1
        assert Held.alive <= 2 * B.PIECE // LONG, "too many rows at once"

    def __del__(self):
        Held.alive -= 1


class Counted:
    def encode(self, text):
        ids, offsets = R.CharTokenizer().encode(text)
        return ids, Held(offsets)


@pytest.fixture
def turns(spark):
    said = F.concat(F.lit("é"), F.repeat(F.lit("ab "), F.lit(LONG // 3)), "id")
    return spark.range(0, ROWS, 1, 1).select(F.col("id").alias("conv_id"), F.explode(F.array(F.lit("user"), F.lit("assistant"))).alias("role"), said.alias("text")).withColumn("turn", F.when(F.col("role") == "user", 0).otherwise(1))


def test_pieces():
    b = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (10, 5000, 10, 10, 10)]), pa.array([[1] * n for n in (1, 2, 3, 4, 500)])], ["a", "b"])
    got = list(B.pieces(b, 3000))
    assert pa.Table.from_batches(got).equals(pa.Table.from_batches([b])) and all(len(p) == 1 or p.nbytes <= 3000 for p in got) and 2 < len(got) <= 5
    assert len(list(B.pieces(b.slice(0, 0), 1))) == 1
    pdf = pd.DataFrame({"a": ["x" * 10, None, "x" * 50, "y", "z"]})
    cut = list(B.frames([pdf, pdf.iloc[:0]], 20))
    assert pd.concat(cut).equals(pdf) and [len(c) for c in cut] == [2, 1, 2, 0]


def test_batches_are_bound(spark):
    """what a worker gets at once doesn't grow with the table."""
    got = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), F.lit(5000)).alias("t")).mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in bs), "n long")
    assert got.agg(F.max("n")).first()[0] < 5 << 20


def test_tokenize_and_mask_in_pieces(spark, turns):
    """a tokenizer sees a piece at a time; labels are those of single rows."""
    got = R.mask(R.tokenize(R.render(turns), Watched()), keep_all=True).select("conv_id", F.size("input_ids").alias("n"), F.size(F.filter("labels", lambda x: x != R.IGNORED)).alias("used"), F.element_at(F.filter("labels", lambda x: x != R.IGNORED), 1).alias("first"), F.length("text").alias("t"))
    size = {i: 3 * (LONG // 3) + 1 + len(str(i)) for i in range(ROWS)}
    assert {r.conv_id: (r.n == r.t, r.used, r.first) for r in got.collect()} == {i: (True, n, ord("é")) for i, n in size.items()}


def _rows(turns):
    m = F.to_json(F.struct("role", F.col("text").alias("content")))
    per = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", m.alias("m")))), lambda x: x["m"]), ",").alias("m"))
    return per.coalesce(1).select(F.concat(F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("source_file"), F.concat(F.lit('{"id":"'), "conv_id", F.lit('","messages":['), "m", F.lit("]}")).alias("text"))


def test_prepare_in_pieces(spark, turns):
    """F7, F8, F10, F11, F12: outcomes leave piece by piece."""
    for s in (P.Settings(tokenizer=Counted()), P.Settings(tokenizer=Counted(), max_length=LONG + 100, policy="trim_followups")):
        got = P.prepare(convert_texts(_rows(turns)), s).select("row_id", "status").collect()
        assert len({r.row_id for r in got}) == len(got) == ROWS


def test_template_memory_is_bounded():
    """every row may bring tools of its own."""
    p = P.Preparer(P.Settings())
    for i in range(600):
        tool = {"type": "function", "function": {"name": f"f{i}", "parameters": {"type": "object", "properties": {}}}}
        assert p.row([{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], [tool])["status"] == "kept"
    assert len(p.template._heads) <= 256


class Steps:
    """Stands for a table, to apply a Python step to given batches."""

    schema = StructType()

    def select(self, *_):
        return self

    def mapInPandas(self, run, _):
        return lambda batches: run(b.to_pandas() for b in batches)

    def mapInArrow(self, run, _):
        return run


def test_convert_in_pieces():
    """rows of converted sessions leave piece by piece."""
    text = json.dumps({"messages": [{"role": "user", "content": "q" * LONG}, {"role": "assistant", "content": "a"}]})
    names = [f"{i}.jsonl" for i in range(ROWS)]
    got = list(convert_texts(Steps())(iter([pa.RecordBatch.from_arrays([pa.array(names), pa.array([text] * ROWS)], ["source_file", "text"])])))
    assert max(map(len, got)) <= B.PIECE // LONG and list(pd.concat(got)["source_file"]) == names


def test_align_in_pieces(spark):
    """labels are aligned piece by piece; nulls stay."""
    df = spark.range(0, ROWS, 1, 1).select("id", F.when(F.col("id") != 7, F.transform(F.sequence(F.lit(1), F.lit(LONG)), lambda x: (x + F.col("id")).cast("int"))).alias("full_ids"))
    out = P.align_labels(df.select("id", F.concat(F.array(F.lit(1)), "full_ids").alias("input_ids"), "full_ids", F.col("full_ids").alias("labels")))
    sizes = out.select("id", F.size("aligned").alias("n"), F.element_at("aligned", 1).alias("a"), F.element_at("aligned", -1).alias("z")).collect()
    assert {r.id: (r.n, r.a, r.z) for r in sizes if r.id != 7} == {i: (LONG + 1, -100, LONG + i) for i in range(ROWS) if i != 7}
    assert next(r for r in sizes if r.id == 7).n in (-1, None)
    ids = pa.array([list(range(LONG))] * ROWS, pa.list_(pa.int32()))
    got = list(P.align_labels(Steps())(iter([pa.RecordBatch.from_arrays([ids] * 3, ["input_ids", "full_ids", "labels"])])))
    assert sum(map(len, got)) == ROWS and max(map(len, got)) <= B.PIECE // (3 * 4 * LONG)


def test_calls_are_checked_in_place(spark):
    """a row isn't repeated for each of its calls, and no shuffle carries it; errors are in the order of the calls."""
    call = "array<struct<id:string,type:string,name:string,arguments:string>>"
    schema = f"k int, messages array<struct<role:string,tool_calls:{call}>>, tools array<struct<name:string,parameters:string>>"
    tool = [("run", '{"type":"object","properties":{"n":{"type":"integer"}},"required":["n"]}')]
    calls = [[("1", "function", "run", '{"n": "x"}'), ("2", "function", "fly", "{}"), ("3", "function", "run", '{"n": 1}')], None, [("4", "function", None, None), ("5", "function", "run", "[")]]
    df = spark.createDataFrame([(1, [("assistant", c) for c in calls], tool), (2, None, tool), (3, [("user", None)], None), (4, [("assistant", calls[0])], None)], schema)
    out = T.validate_tool_calls(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    got = {r.k: r.errors for r in out.collect()}
    assert got[1] == ["run.arguments.n: expected integer, got string", "fly: not declared", "call without a name", "run: arguments are not a JSON object"]
    assert got[2] == got[3] == [] and got[4] == ["run: not declared", "fly: not declared", "run: not declared"]
