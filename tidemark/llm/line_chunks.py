"""Line deduplication by content-defined chunks, in DataFrame functions only.

A rolling hash runs over the hashes of every two neighbouring lines that are not blank. Where it is least among its
neighbours, the chunk of those two lines begins and ends; the lines between two such chunks are a chunk too. Boundaries
depend on nearby lines alone, so an inserted line moves none beyond it. A passage of few lines may begin and end off the
boundaries, therefore ``BASES`` holds several bases of the hash, each with boundaries of its own: of the lines of sf0.1
that stand in two or more neighbouring lines of an earlier document one base finds 72 %, four find 96 %.

Chunks with two or more lines that are not blank are counted by hash over all documents, whatever base made them; the
copies of a repeated hash are compared byte by byte with the chunk of the least (doc_id, line), which is no copy. Equal
ones go, with the blank lines after them. A line goes only for an equal line before it, so one of each stays. Where
repeated chunks of several bases cover a line, the one of the first base is compared.

First only hashes are shuffled; texts are dealt by document twice, to read the repeated chunks and to cut them, and only
repeated chunks meet by their hash. Counting combines before the shuffle; the joins have one row per hash on one side,
so adaptive execution can split a hot hash on the other.

Defined results: a null text stays null, an empty one empty; rows with a null id are neither source nor target; equal
rows are one document for counting and are all returned; the same id with another text is another document. All columns
are kept, ``text`` holds the remaining lines, two columns count all and removed lines; they take the place of input
columns of the same names, ``counts`` gives them others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written

BASES = (31, 1_000_003, 69_069, 1_664_525)
PRIME = 2_147_483_647
COUNTS = ("n_lines", "n_removed")


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def _rolled(hashes: str, base: int) -> Column:
    after = F.slice(hashes, 2, F.greatest(F.size(hashes) - 1, F.lit(0)))
    return F.filter(F.zip_with(hashes, after, lambda a, b: (a * base + b) % PRIME), lambda r: r.isNotNull())


def _least(rolled: str) -> Column:
    """For every two neighbouring lines, whether their hash is below that before and not above that after."""
    return F.transform(rolled, lambda r, i: F.coalesce(r < F.get(rolled, i - 1), F.lit(True)) & F.coalesce(r <= F.get(rolled, i + 1), F.lit(True)))


def _ends(least: str, hashes: str) -> Column:
    """Numbers of the filled lines that end a chunk: the second line of a least pair, the line before it, the last line."""
    ends = F.transform(hashes, lambda h, j: F.when(
        F.coalesce(F.get(least, j - 1), F.lit(False)) | F.coalesce(F.get(least, j + 1), F.lit(False)) | (j == F.size(hashes) - 1), j))
    return F.filter(ends, lambda j: j.isNotNull())


def _spans(ends: str) -> Column:
    """Chunks of two or more filled lines as (first, last, line after the blank ones that follow), counted from 0."""
    starts = F.concat(F.array(F.lit(0)), F.transform(F.slice(ends, 1, F.size(ends) - 1), lambda e: e + 1))
    spans = F.filter(F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e"))), lambda c: c["s"] < c["e"])
    return F.transform(spans, lambda c: F.struct(F.get("__at", c["s"]).alias("first"), F.get("__at", c["e"]).alias("last"),
                                                 F.coalesce(F.get("__at", c["e"] + 1), F.size("__lines")).alias("until")))


def with_chunks(df: DataFrame, text: str = "__text", bases: Sequence[int] = BASES) -> DataFrame:
    """Rows whose text has two filled lines, with ``__lines`` and ``__chunks``, the distinct chunks of all bases.

    Every step is a column of its own that the next one reads more than once, so that no lambda computes it anew.
    """
    kept = df.columns
    df = df.withColumn("__lines", F.split(F.col(text), "\n", -1))
    df = df.withColumn("__at", F.filter(F.transform("__lines", lambda line, i: F.when(F.trim(line) != "", i)), lambda i: i.isNotNull()))
    df = df.where(F.size("__at") > 1).withColumn("__hashes", F.transform("__at", lambda i: _line_hash(F.get("__lines", i))))
    each = range(len(bases))
    df = df.withColumns({f"__rolled{b}": _rolled("__hashes", bases[b]) for b in each})
    df = df.withColumns({f"__least{b}": _least(f"__rolled{b}") for b in each})
    df = df.withColumns({f"__ends{b}": _ends(f"__least{b}", "__hashes") for b in each})
    return df.withColumn("__chunks", F.array_distinct(F.concat(*[_spans(f"__ends{b}") for b in each]))).select(*kept, "__lines", "__chunks")


def remove_repeated_chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bases: Sequence[int] = BASES,
                           counts: tuple[str, str] = COUNTS) -> DataFrame:
    """The columns of ``docs`` with the text cut, then the two ``counts``."""
    names = [c for c in docs.columns if c not in counts]
    own = docs.select(F.col(doc_id).cast("long").alias("__id"), F.xxhash64(F.col(text)).alias("__digest"), F.col(text).alias("__text"),
                      *[F.col(c).alias(f"__c_{c}") for c in names if c != text])
    # place and hash of every chunk
    places = (with_chunks(own.where("__id IS NOT NULL").select("__id", "__digest", "__text"), bases=bases)
              .select("__id", "__digest", F.posexplode(F.transform("__chunks", lambda c: F.struct(
                  F.xxhash64(F.slice("__lines", c["first"] + 1, c["last"] - c["first"] + 1)).alias("hash"), c["first"].alias("first"),
                  c["last"].alias("last"), c["until"].alias("until")))).alias("no", "chunk"))
              .select("__id", "__digest", "no", "chunk.*"))
    sources = (places.groupBy("hash").agg(F.min(F.struct("__id", "__digest", "first", "last")).alias("source"), F.count(F.lit(1)).alias("copies"))
               .where("copies > 1").drop("copies"))
    copies = (places.join(sources, "hash")
              .where(F.struct("__id", "__digest", "first") != F.struct("source.__id", "source.__digest", "source.first"))
              .select("__id", "__digest", "no", "hash", "first", "last", "until", "source").repartition("__id", "__digest"))
    # of the copies that cover a line, the one with the least number
    of_line = Window.partitionBy("__id", "__digest", "line")
    needed = written(copies.withColumn("line", F.explode(F.sequence("first", "last"))).withColumn("least", F.min("no").over(of_line)).where("no = least")
                     .groupBy("__id", "__digest", "hash", "first", "last", "until", "source").agg(F.lit(False).alias("is_source")))
    asked = needed.select("hash", "source.*").distinct().select("__id", "__digest", F.struct(
        "hash", "first", "last", F.col("last").alias("until"), F.lit(True).alias("is_source")).alias("mark"))
    marks = (needed.select("__id", "__digest", F.struct("hash", "first", "last", "until", "is_source").alias("mark")).unionByName(asked)
             .groupBy("__id", "__digest").agg(F.collect_list("mark").alias("__marks")))

    # the texts of repeated chunks, compared with the source of their hash
    keyed = own.repartition("__id", "__digest")
    held = keyed.select("__id", "__digest", "__text").join(marks, ["__id", "__digest"]).withColumn("__lines", F.split("__text", "\n", -1))
    # written once: both sides of the comparison read these few texts instead of dealing out all texts twice
    pieces = written(held.select("__id", "__digest", F.explode(F.transform("__marks", lambda m: F.struct(
        m["hash"].alias("hash"), m["first"].alias("first"), m["until"].alias("until"), m["is_source"].alias("is_source"),
        F.array_join(F.slice("__lines", m["first"] + 1, m["last"] - m["first"] + 1), "\n").alias("chunk")))).alias("p")).select("__id", "__digest", "p.*"))
    originals = pieces.where("is_source").select("hash", F.col("chunk").alias("original")).distinct()
    gone = (pieces.where("NOT is_source").join(originals, "hash").where("chunk = original")
            .groupBy("__id", "__digest").agg(F.collect_set(F.struct("first", "until")).alias("__gone")))

    left = keyed.join(gone, ["__id", "__digest"], "left").withColumn("__lines", F.split("__text", "\n", -1))
    every = F.sequence(F.lit(0), F.size("__lines") - 1)
    cut = left.withColumn("__stays", F.when(F.col("__gone").isNotNull(), F.array_except(
        every, F.flatten(F.transform("__gone", lambda g: F.sequence(g["first"], g["until"] - 1))))))
    whole = F.col("__gone").isNull()
    n_lines = F.when(F.col("__text").isNull(), 0).otherwise(F.size("__lines")).cast("long")
    kept = F.array_join(F.transform("__stays", lambda i: F.get("__lines", i)), "\n")
    row = F.struct(F.when(whole, F.col("__text")).otherwise(kept).alias("__new"), n_lines.alias(counts[0]),
                   F.when(whole, F.lit(0)).otherwise(n_lines - F.size("__stays")).cast("long").alias(counts[1]))
    # a row generated from an array of one: what reads the new columns cannot pull their expressions into itself and repeat them
    done = cut.select(*[f"__c_{c}" for c in names if c != text], F.inline(F.array(row)))
    return done.select(*[(F.col("__new") if c == text else F.col(f"__c_{c}")).alias(c) for c in names], *counts)


ORACLE = f"""
WITH texts AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
each AS (SELECT doc_id, unnest(lines) AS line, unnest(range(0, len(lines))) AS i FROM texts),
filled AS (SELECT doc_id, i, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h, row_number() OVER w - 1 AS j, lead(i) OVER w AS next_i
           FROM each WHERE trim(line, ' ') <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
bases AS (SELECT unnest({list(BASES)}) AS base),
rolled AS (SELECT doc_id, base, j, (h * base + lead(h) OVER (PARTITION BY doc_id, base ORDER BY j)) % {PRIME} AS r FROM filled, bases),
least AS (SELECT doc_id, base, j, coalesce(r < lag(r) OVER w, TRUE) AND coalesce(r <= lead(r) OVER w, TRUE) AS is_least
          FROM rolled WHERE r IS NOT NULL WINDOW w AS (PARTITION BY doc_id, base ORDER BY j)),
ends AS (SELECT doc_id, base, j + 1 AS j FROM least WHERE is_least UNION SELECT doc_id, base, j - 1 FROM least WHERE is_least AND j > 0
         UNION SELECT doc_id, base, max(j) + 1 FROM least GROUP BY doc_id, base),
spans AS (SELECT doc_id, coalesce(lag(j) OVER (PARTITION BY doc_id, base ORDER BY j) + 1, 0) AS a, j AS b FROM ends),
chunks AS (SELECT DISTINCT s.doc_id, f.i AS first, coalesce(l.next_i, len(t.lines)) AS until, array_to_string(t.lines[f.i + 1:l.i + 1], chr(10)) AS chunk
           FROM spans s JOIN filled f ON f.doc_id = s.doc_id AND f.j = a JOIN filled l ON l.doc_id = s.doc_id AND l.j = b JOIN texts t ON t.doc_id = s.doc_id
           WHERE a < b),
judged AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, first) > 1 AS is_copy FROM chunks),
gone AS (SELECT DISTINCT doc_id, unnest(range(first, until)) AS i FROM judged WHERE is_copy),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CAST(coalesce(len(t.lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(t.lines), 0) - coalesce(k.n, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN texts t ON d.doc_id = t.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
