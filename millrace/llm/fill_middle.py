"""Fill-in-the-middle transformation by lookaround splitting, in DataFrame functions alone.

A unit grammar says how a text falls into units. Each is translated into a zero-width expression:
a unit ends between two neighbouring characters, of which the left one is of one class (looked
back at) and the right one of another (looked ahead at). ``split`` by that expression removes
nothing, so the pieces put together are the text; the empty text, which ``split`` gives one piece,
has no units and is handled on its own.

Two cuts among the units, by hashes of seed and id, give prefix, middle and suffix; two more hashes
say whether a text stays plain and in which order the parts come. A text that holds one of the
marks stays plain, so that an output falls apart at its marks in one way only: ``restored``.

Each row is worked on alone; nothing is shuffled. Null and empty texts have no units and stay plain,
with an empty output. A null id hashes as empty text. Very long texts are split whole. Repeated rows
give repeated results. Columns beside doc_id and text are not read, whatever they are called. An
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"\x20\x09-\x0D"
#: For each unit grammar, what it matches, and the classes left and right of a boundary, by alternatives.
#: Classes left of a boundary hold the low half of a surrogate pair if they hold the pair, as Java looks back by halves.
UNITS: dict[str, tuple[str, tuple[tuple[str, str], ...]]] = {
    "word": (rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+", ((rf"[^{SPACE}]", rf"[{SPACE}]"),)),
    "line": (r"[^\n]*\n|[^\n]+", ((r"\n", r"[\s\S]"),)),
    "run": (rf"[^{SPACE}]+|[{SPACE}]+", ((rf"[^{SPACE}]", rf"[{SPACE}]"), (rf"[{SPACE}]", rf"[^{SPACE}]"))),
}
MARKS = ("<P>", "<S>", "<M>")


def boundary(unit: str) -> str:
    """The zero-width expression at which the units of a grammar part."""
    return "|".join(f"(?<={left})(?={right})" for left, right in UNITS[unit][1])


def units(text: Column, unit: str = "word") -> Column:
    """The units of a text, as an array; none of the empty text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(unit)))


def _quoted(marks: tuple[str, str, str]) -> str:
    return "|".join(rf"\Q{m}\E" for m in marks)


def fill_in_middle(docs: DataFrame, unit: str = "word", seed: int = 42, rate: int = 50, spm: int = 80, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every document (doc_id, text).

    ``rate`` of a hundred texts are cut; of these, ``spm`` of a hundred have their suffix first. ``marks`` stand
    before prefix, suffix and middle. Lengths are in code points, null where the form is plain.
    """
    p, s, m = marks
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = lambda i: F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long")
    text = F.coalesce("text", F.lit(""))
    marked = F.contains(F.col("text"), F.lit(p)) | F.contains(F.col("text"), F.lit(s)) | F.contains(F.col("text"), F.lit(m))
    form = F.when((F.col("text") == "") | marked | (F.col("h3") % 100 >= rate), "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    rows = docs.select("doc_id", text.alias("text"), digest.alias("digest")).withColumns({f"h{i + 1}": h(i) for i in range(4)})
    rows = rows.select("doc_id", "text", "h1", "h2", form.alias("form"), units(F.col("text"), unit).alias("units"))
    rows = rows.withColumn("n", F.size("units").cast("long"))
    cut = [(F.col(c) % (F.col("n") + 1)).cast("int") for c in ("h1", "h2")]
    rows = rows.select("doc_id", "text", "form", "units", "n", F.least(*cut).alias("i"), F.greatest(*cut).alias("j"))
    whole = F.col("form") == "plain"
    joined = lambda a, b: F.when(~whole, F.array_join(F.slice("units", a + 1, b - a), ""))
    i, j = F.col("i"), F.col("j")
    rows = rows.select("doc_id", "text", "form", "n", joined(F.lit(0), i).alias("prefix"), joined(i, j).alias("middle"), joined(j, F.col("n").cast("int")).alias("suffix"))
    first = F.when(F.col("form") == "psm", F.concat(F.lit(p), "prefix", F.lit(s), "suffix")).otherwise(F.concat(F.lit(s), "suffix", F.lit(p), "prefix"))
    output = F.when(whole, F.col("text")).otherwise(F.concat(first, F.lit(m), "middle"))
    lengths = [F.length(c).cast("long").alias(f"{c}_chars") for c in ("prefix", "middle")]
    return rows.select("doc_id", "n", "form", *lengths, output.alias("output"))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of the given form was made of."""
    parts = F.split(output, _quoted(marks))  # nothing stands before the first mark
    part = lambda i: F.element_at(parts, F.lit(i))
    return F.when(form == "plain", output).when(form == "psm", F.concat(part(2), part(4), part(3))).otherwise(F.concat(part(3), part(4), part(2)))


def digests(rows: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """The rows of ``fill_in_middle`` with sha256 of their outputs and of the texts rebuilt from these."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    back = restored(F.col("output"), F.col("form"), marks)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(back).alias("restored_sha256"))


SQL = r"""
with d as (select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(doc_id::varchar, '')) as x from documents),
h as (select doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u,
  ('0x' || x[1:8])::bigint as h1, ('0x' || x[9:16])::bigint as h2, ('0x' || x[17:24])::bigint as h3, ('0x' || x[25:32])::bigint as h4 from d),
c as (select *, len(u) as n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) as i, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) as j,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from h),
p as (select *, array_to_string(u[1:i], '') as a, array_to_string(u[i + 1:j], '') as b, array_to_string(u[j + 1:], '') as z from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(a) end as prefix_chars, case when form <> 'plain' then length(b) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || a || '<S>' || z || '<M>' || b else '<S>' || z || '<P>' || a || '<M>' || b end) as output_sha256,
  sha256(text) as restored_sha256 from p
"""
