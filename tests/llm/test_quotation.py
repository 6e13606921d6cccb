import random
import re

from pyspark.sql import functions as F

from tidemark.llm import quotation
from tidemark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def norm(text):
    return re.sub(r"[\W_]+", " ", text.lower()).strip()


def parse(text):
    lines = []
    for line in text.split("\n"):
        m = re.match(r"((?:[ \t]*>)+)[ \t]?", line)
        lines.append([m[1].count(">"), line[m.end():]] if m else [0, line])
    for a, b in zip(lines, lines[1:]):
        if a[0] == 0 and b[0] > 0 and re.match(r"(?i)^.*\b(wrote|writes|said|schrieb|escribió|a écrit)\s*:\s*$", a[1]):
            a[0] = -1
    return lines


def brute(messages):
    own, out = {}, {}
    for conv, turn, _, text in messages:
        lines = parse(text)
        mine = [b for lv, b in lines if lv == 0]
        for words, whole in [(norm(b), False) for b in mine] + [(norm("\n".join(mine)), True)]:
            if words:
                key = (conv, words, whole)
                own[key] = min(own.get(key, turn), turn)
    parent = {}
    for conv, turn, _, text in messages:
        first = [b for lv, b in parse(text) if lv == 1]
        votes = {}
        for words, whole in {(norm(b), False) for b in first} | {(norm("\n".join(first)), True)}:
            origin = own.get((conv, words, whole))
            if words and origin is not None and origin < turn:
                votes[origin] = votes.get(origin, 0) + len(words)
        if votes:
            parent[conv, turn] = max(votes, key=lambda o: (votes[o], o))
    for conv, turn, _, text in messages:
        path = [turn]
        while (conv, path[0]) in parent:
            path.insert(0, parent[conv, path[0]])
        out[conv, turn] = path
    return out


def made_conversations(seed, n):
    rng, rows = random.Random(seed), []
    for conv in range(n):
        texts = []
        for turn in range(rng.randrange(1, 14)):
            lines = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 4))]
            text = "\n".join(lines)
            if texts and rng.random() < 0.7:
                source = rng.choice(texts).split("\n")
                quote = source if rng.random() < 0.6 else source[:1]
                if rng.random() < 0.2:
                    quote = " ".join(quote).upper().split("  ")
                text = "Someone wrote:\n" + "\n".join(f"> {q}" for q in quote) + "\n\n" + text
            texts.append(text)
            rows.append((conv, turn, "user", text))
    return rows


def test_equals_brute_force(spark):
    rows = made_conversations(1, 40)
    found = quotation.thread_messages(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert {(r.conv_id, r.turn): list(r.path) for r in found} == brute(rows)
    assert any(len(r.path) > 3 for r in found)
    for r in found:
        assert ">" not in r.text and "wrote:" not in r.text and r.reply_to_turn == (r.path[-2] if len(r.path) > 1 else None)


def test_nested_levels_and_text(spark):
    rows = [(1, 0, "user", "How do I sort?\nThanks"), (1, 1, "assistant", "On Monday A wrote:\n> How do I sort?\n> Thanks\n\nUse sort()."),
            (1, 2, "user", "> On Monday A wrote:\n> > How do I sort?\n> Use sort().\n\nAnd in reverse?\n>"), (1, 3, "user", "no quote > here")]
    found = {r.turn: r for r in quotation.thread_messages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[1].text == "Use sort()." and list(found[1].path) == [0, 1] and found[1].n_quote_lines == 2
    assert found[2].text == "And in reverse?" and list(found[2].path) == [0, 1, 2] and found[2].n_levels == 2
    assert found[3].text == "no quote > here" and list(found[3].path) == [3]
    assert found[1].message == '{"role":"assistant","content":"Use sort()."}'


def test_long_chain(spark):
    rows = [(7, 0, "user", "line 0")] + [(7, i, "user", f"> line {i - 1}\nline {i}") for i in range(1, 70)]
    found = {r.turn: list(r.path) for r in quotation.thread_messages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[69] == list(range(70))


def test_edges(spark):
    rows = [(None, 0, "user", "> a"), (1, None, "user", "a"), (1, 1, None, None), (1, 2, "user", ""), (1, 2, "user", ""), (1, 3, "user", ">>>"), (2, 0, "user", "a"), (2, 0, "user", "> a")]
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("path", "level", "head", "origin")})
    found = quotation.thread_messages(table).collect()
    assert len(found) == len(rows) and sum(r.path is None for r in found) == 2
    assert {r.text for r in found if r.turn == 1} == {None}
    assert quotation.thread_messages(table.limit(0)).count() == 0


def test_query_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = QUERIES["op7_quotation"](spark, FOLDER).collect()
    assert len(found) == len(rows) and {(r.conv_id, r.turn): list(r.path) for r in found} == brute(rows)
