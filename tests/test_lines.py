"""Numbers of lines against the files' own, at several sizes of splits."""

import json
import random

import pytest

from millrace.sources import lines


@pytest.mark.parametrize("split", [64, 1_000, 1 << 27])
def test_numbers(spark, tmp_path, split):
    rng, seq, want = random.Random(split), 0, []
    for name in ("a", "b0", "c"):
        body = [rng.choice(["", "  ", "x", "漢字" * rng.randint(1, 40), "y" * rng.randint(1, 3_000), "x"]) for _ in range(150)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(body) + ("\n" if name == "a" else ""), encoding="utf-8")
        for line, value in enumerate(v for v in body if v.strip()):
            want.append((seq, name, line, value))
            seq += 1
    (tmp_path / "b1.jsonl").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        df = lines.numbered(spark, f"file://{tmp_path}")
        got = sorted((r.seq, r.file.rsplit("/", 1)[1].split(".")[0], r.line, r.value) for r in df.collect())
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert got == want
        assert "Sort " not in plan.split("Join")[0] or "BroadcastHashJoin" in plan
        blanks = lines.numbered(spark, f"file://{tmp_path}/a.jsonl", blank=True)
        assert sorted(r.line for r in blanks.collect()) == list(range(150))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_other_splits_raise(spark, tmp_path):
    (tmp_path / "f.txt").write_text("\n".join(f"line {i}" for i in range(2_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4_000)
    try:
        df = lines.numbered(spark, f"file://{tmp_path}")
        spark.conf.set("spark.sql.files.maxPartitionBytes", 7_000)
        again = df.select("*")
        try:
            numbers = {r.value: r.seq for r in again.collect()}
        except Exception as e:  # noqa: BLE001
            assert "split otherwise" in str(e)
        else:
            assert numbers == {f"line {i}": i for i in range(2_000)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_records(spark, tmp_path):
    rows = [{"question": q, "n": i} for i, q in enumerate(["a", "", None, " ", "b", "c"])]
    (tmp_path / "f.jsonl").write_text("\n\n".join(json.dumps(r) for r in rows))
    read = lambda n=None: lines.records(spark, f"file://{tmp_path}/f.jsonl", "question string, n long", n)
    assert sorted((r.seq, r.n) for r in read().collect()) == [(i, i) for i in range(6)]
    assert sorted(r.n for r in read(2).collect()) == [0, 1]
    assert [r.question for r in lines.first_asked(read(), 2).collect()] == ["a", "b"]
    (tmp_path / "f.jsonl").write_text('{"question": "a"}\n{broken')
    with pytest.raises(Exception, match="(?i)malformed"):
        read().collect()
