"""A model as a stage: failures by row, retries, kept results, and how often it was asked."""

import collections
import os
import uuid

import pytest

from millrace.operators import model_stage, reports


def counting(folder, answer):
    """The model, noting each row of each call in a folder of its own."""
    def model(batch):
        for r in batch:
            with open(os.path.join(folder, f"{uuid.uuid4().hex}"), "w", encoding="utf-8") as f:
                f.write(str(r["text"]))
        return [answer(r) for r in batch]
    return model


def asked(folder):
    return collections.Counter(open(os.path.join(folder, n), encoding="utf-8").read() for n in os.listdir(folder))


def lengths(r):
    if r["text"] is None:
        raise ValueError("no text")
    return ValueError("bad row") if r["text"] == "bad" else {"n": len(r["text"]), "items": list(r["text"])[:2]}


def rows_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)


def test_failures_by_row(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(model_stage, "HOT", 4)
    calls = tmp_path / "calls"
    calls.mkdir()
    texts = ["a", "bb", "", None, "bad", "漢字", "x" * 200_000, '"quoted"\n\\'] + ["copy"] * 30 + [None]
    rows = rows_of(spark, texts)
    out = model_stage.applied(rows, ["text"], counting(str(calls), lengths), "n int, items array<string>", f"file://{tmp_path}/store", "v1").collect()
    assert sorted(r.id for r in out) == list(range(len(texts)))
    for r in out:
        if r.text is None or r.text == "bad":
            assert r.result is None and r.error == ("ValueError: no text" if r.text is None else "ValueError: bad row")
        else:
            assert r.error is None and (r.result.n, r.result["items"]) == (len(r.text), list(r.text)[:2])
    assert asked(calls)["copy"] <= 4  # a failing batch is tried three times, then each of its rows alone
    before = sum(asked(calls).values())
    more = rows_of(spark, texts + ["new"])
    again = model_stage.applied(more, ["text"], counting(str(calls), lengths), "n int, items array<string>", f"file://{tmp_path}/store", "v1")
    assert again.count() == len(texts) + 1 and again.where("text = 'new'").first().result.n == 3
    assert sum(asked(calls).values()) == before + 1
    stats = reports.extraction_stats(again.selectExpr("result.items as items", "error")).first()
    assert (stats.candidates, stats.failed, stats["empty"]) == (len(texts) + 1, 3, 1)


def test_retry_and_again(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()

    def flaky(batch):
        mark = os.path.join(str(seen), batch[0]["text"])
        if not os.path.exists(mark):
            open(mark, "w").close()
            raise RuntimeError("try later")
        return [{"n": 1} for _ in batch]

    store, rows = f"file://{tmp_path}/store", rows_of(spark, ["p", "q", "p"])
    once = model_stage.applied(rows, ["text"], flaky, "n int", store, "v", attempts=1).collect()
    assert {r.text for r in once} == {"p", "q"} and all((r.error is None) != (r.result is None) for r in once)
    assert model_stage.applied(rows, ["text"], flaky, "n int", store, "v", attempts=1).where("error is null").count() == sum(r.error is None for r in once)
    assert model_stage.applied(rows, ["text"], flaky, "n int", store, "v", attempts=2, again=True).where("result.n = 1 and error is null").count() == 3


@pytest.mark.parametrize("result", [{"n": "word"}, {}, None, {"n": [1]}, {"n": float("nan")}])
def test_results_that_do_not_fit(spark, tmp_path, result):
    out = model_stage.applied(rows_of(spark, ["a", "b"]), ["text"], lambda batch: [result for _ in batch], "n int", f"file://{tmp_path}/s", "v").collect()
    assert all(r.result is None and r.error for r in out) and len(out) == 2


def test_wrong_length_empty_and_clash(spark, tmp_path, monkeypatch):
    out = model_stage.applied(rows_of(spark, ["a", "b"]), ["text"], lambda batch: [], "n int", f"file://{tmp_path}/s", "v").collect()
    assert all("0 results for 1 rows" in r.error for r in out)
    assert model_stage.applied(rows_of(spark, ["a"]).where("false"), ["text"], None, "n int", f"file://{tmp_path}/t", "v").collect() == []
    with pytest.raises(ValueError, match="own names"):
        model_stage.applied(rows_of(spark, ["a"]).withColumnRenamed("id", "error"), ["text"], None, "n int", f"file://{tmp_path}/u", "v")
    monkeypatch.setattr(model_stage, "PORTION", 7)
    many = rows_of(spark, [str(i) for i in range(100)])
    assert many.count() == model_stage.applied(many, ["text"], lambda b: [{"n": int(r["text"])} for r in b], "n int", f"file://{tmp_path}/w", "v").where("result.n = cast(text as int)").count()


def test_auditor_failure_rejects(spark, tmp_path):
    def judge(batch):
        if any(r["question"] == "boom" for r in batch):
            raise RuntimeError("down")
        return [{"approved": r["corrected_label"] == "new", "authoritative_label": r["corrected_label"], "reason": "ok"} for r in batch]

    samples = spark.createDataFrame([("q", "old", "new"), ("boom", "old", "new"), ("r", "old", "other")], "question string, original_label string, corrected_label string")
    got = {r.question: (r.approved, r.authoritative_label, r.reason, r.failed) for r in model_stage.audited(samples, judge, f"file://{tmp_path}/a", "v").collect()}
    assert got == {"q": (True, "new", "ok", False), "r": (False, "other", "ok", False), "boom": (False, "old", "审核异常: RuntimeError: down", True)}
