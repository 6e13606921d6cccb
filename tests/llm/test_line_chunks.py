import hashlib

import oracle
import pytest
from pyspark.sql import functions as F

from tidemark.llm import line_chunks
from tidemark.llm.queries import ORACLES, QUERIES


def chunks_of(lines, base):
    """(first, last, until) of the chunks of two or more filled lines."""
    at = [i for i, line in enumerate(lines) if line.strip(" ")]
    h = [int(hashlib.md5(lines[i].encode()).hexdigest()[:8], 16) for i in at]
    rolled = [(a * base + b) % line_chunks.PRIME for a, b in zip(h, h[1:])]
    least = [i for i, r in enumerate(rolled) if (i == 0 or r < rolled[i - 1]) and (i + 1 == len(rolled) or r <= rolled[i + 1])]
    out, begin = [], 0
    for end in sorted({i + 1 for i in least} | {i - 1 for i in least if i} | {len(at) - 1}):
        if end > begin:
            out.append((at[begin], at[end], at[end + 1] if end + 1 < len(at) else len(lines)))
        begin = end + 1
    return out


def brute(docs, bases=line_chunks.BASES):
    docs = sorted(docs, key=lambda d: d[0])
    found = sorted({(doc, *c, "\n".join(text.split("\n")[c[0]:c[1] + 1])) for doc, text in docs if text is not None
                    for base in bases for c in chunks_of(text.split("\n"), base)})
    seen, gone, out = set(), {}, {}
    for doc, first, _, until, chunk in found:
        if chunk in seen:
            gone.setdefault(doc, set()).update(range(first, until))
        seen.add(chunk)
    for doc, text in docs:
        lines = [] if text is None else text.split("\n")
        kept = [line for i, line in enumerate(lines) if i not in gone.get(doc, ())]
        out[doc] = (None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def as_dict(df):
    return {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in df.collect()}


@pytest.mark.parametrize("bases", [(31,), line_chunks.BASES])
def test_equals_brute_force(spark, make_docs, prose, bases):
    docs = [(i, prose(i % 7, 30 + i, 9, "\n") + "\n" + prose(i, 10, 5, "\n")) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "\n\n\n"), (103, "one"), (104, docs[0][1]), (105, docs[0][1] + "\n"), (106, " \n \n" * 9), (108, "w1\n\n" * 9), (109, docs[3][1].replace("\n", "\n\n")), (110, "\n\n" + docs[4][1] + "\n \n" + docs[5][1]), (107, prose(1, 5000, 9, "\n"))]
    assert as_dict(line_chunks.remove_repeated_chunks(make_docs(docs), bases=bases)) == brute(docs, bases)


def test_edges(spark, make_docs, prose):
    text = prose(5, 40, 30, "\n")
    docs = make_docs([(1, text), (1, text), (None, text), (2, text)])
    found = sorted(((r.doc_id, r.n_removed > 0) for r in line_chunks.remove_repeated_chunks(docs).collect()), key=str)
    assert found == [(1, False), (1, False), (2, True), (None, False)]
    assert line_chunks.remove_repeated_chunks(docs.limit(0)).count() == 0
    wide = docs.withColumns({c: F.lit(1) for c in ("hash", "no", "first", "chunk", "p")})
    assert line_chunks.remove_repeated_chunks(wide).columns == [*wide.columns, "n_lines", "n_removed"]


def test_clashing_columns(spark, make_docs, prose):
    text = prose(5, 40, 30, "\n")
    docs = make_docs([(1, text), (2, text)]).withColumns({c: F.lit(7) for c in ("n_lines", "n_removed", "__text", "__id", "__digest", "hash", "line", "least")})
    cut = line_chunks.remove_repeated_chunks(docs)
    assert cut.columns == [*[c for c in docs.columns if c not in line_chunks.COUNTS], *line_chunks.COUNTS]
    assert {r.doc_id: (r.n_lines, r.n_removed, r.least) for r in cut.collect()} == {1: (40, 0, 7), 2: (40, 40, 7)}
    named = line_chunks.remove_repeated_chunks(docs, counts=("a", "b")).collect()
    assert {(r.n_lines, r.n_removed, r.a) for r in named} == {(7, 7, 40)}


def test_insertion_moves_no_far_boundary(prose):
    lines = prose(8, 200, 50, "\n").split("\n")
    plain, shifted = chunks_of(lines, 31), [(a - 1, b - 1, c - 1) for a, b, c in chunks_of(["new", *lines], 31)]
    assert plain[3:] == shifted[-len(plain) + 3:]


def test_one_of_each_line_stays_and_passages_go(spark, make_docs, prose):
    """Passages of 2 to 6 lines at any place of many documents; every line that goes stays somewhere else."""
    passages = {k: [f"shared {k} {i} " + prose(k, 9) for i in range(2 + k % 5)] for k in range(60)}
    docs = []
    for i in range(240):
        own = [f"own {i} {j} " + prose(i * 31 + j, 6, 500) for j in range(9)]
        docs.append((i, "\n".join(own[:i % 9] + passages[i % 60] + own[i % 9:])))
    cut = {d: set(t[0].split("\n")) for d, t in as_dict(line_chunks.remove_repeated_chunks(make_docs(docs))).items()}
    before = {d: set(t.split("\n")) for d, t in docs}
    assert set().union(*cut.values()) == set().union(*before.values())
    assert all(line in cut[d] for d in before for line in before[d] if line.startswith("own"))
    copies = [(d, line) for d in before for line in before[d] if d >= 60 and line.startswith("shared")]
    assert sum(line not in cut[d] for d, line in copies) >= 0.9 * len(copies)


def test_query_matches_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert oracle.compare(QUERIES["op2_line_chunks"](spark, folder), oracle.connect(folder), ORACLES["op2_line_chunks"]) == []


def test_native_and_split_once(spark, make_docs):
    df = line_chunks.remove_repeated_chunks(make_docs([(1, "a\nb")]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
    for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines():
        assert line.count("split(") <= 1 and not ("split(" in line and "md5(" in line)
