import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from linewright.llm import ball_tree, kd_shards, prefix_chat
from linewright.session import fresh_dir

from .conftest import SCHEMA, prose

TURNS = "conv_id bigint, turn bigint, role string, text string"


def check_shards(frame, rows, shards, tolerance):
    got = kd_shards.digest(kd_shards.assign(frame, shards)).collect()
    want = sorted(
        (str(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows
    )
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
    sizes, slots = {}, {}
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if tolerance is not None:
        target = sum(sizes.values()) / shards
        assert len(sizes) == shards
        assert all(abs(s - target) <= tolerance for s in sizes.values())
    return got


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_shards_of_equal_bytes(docs, shards):
    rows = [(i * 3, prose(i, 1 + i % 40)) for i in range(600)]
    # A third of all rows have one text, source and language.
    rows = [(d, "the same text" if d % 9 == 0 else t) for d, t in rows]
    frame = docs(rows).selectExpr("*", "1 AS size", "2 AS tie", "3 AS shard", "4 AS d0")
    largest = max(len(t) for _, t in rows) + 8
    check_shards(frame, rows, shards, 3 * largest)


def test_shards_of_odd_tables(spark, docs, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    check_shards(odd_docs, rows, 24, None)
    assert kd_shards.assign(spark.createDataFrame([], SCHEMA)).count() == 0
    same = [(1, "equal")] * 50
    check_shards(docs(same), same, 24, None)
    bare = docs(rows).select("doc_id", "text")
    check_shards(bare, rows, 3, None)


def test_written_shards(spark, docs):
    rows = [(i, prose(i, 20)) for i in range(100)]
    folder = fresh_dir(spark, "test-shards")
    kd_shards.write_shards(docs(rows), folder, 6)
    stored = spark.read.parquet(folder)
    assert {(r.doc_id, r.text) for r in stored.collect()} == set(rows)
    placed = {r.doc_id: r.shard for r in kd_shards.assign(docs(rows), 6).collect()}
    assert {r.doc_id: r.shard for r in stored.collect()} == placed


def brute_top(rows, k):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            good[i] = [int(np.floor(64 * float(np.float32(x)))) for x in v]
    result = set()
    for q, a in good.items():
        if q % 20 == 0:
            scores = [
                (-sum(x * y for x, y in zip(a, b)), i)
                for i, b in good.items()
                if i != q and len(a) == len(b)
            ]
            for rank, (score, i) in enumerate(sorted(scores)[:k], 1):
                result.add((q, rank, i, -score))
    return result


@pytest.mark.parametrize("points, leaf", [(16384, 128), (40, 4)])
def test_top_k(spark, monkeypatch, points, leaf):
    monkeypatch.setattr(ball_tree, "LEAF", leaf)
    monkeypatch.setattr(ball_tree, "BLOCK_QUERIES", 7 if leaf == 4 else 4096)
    monkeypatch.setattr(ball_tree, "BLOCK_BALLS", 3 if leaf == 4 else 4096)
    random = np.random.default_rng(4)
    rows = [(i, random.normal(size=8).astype(np.float32).tolist()) for i in range(400)]
    rows = [(i, rows[3][1] if i % 3 == 0 else v) for i, v in rows]
    rows += [(1000 + 20 * i, (np.array(rows[i][1]) * 3).tolist()) for i in range(5)]
    rows += [(2000, None), (2020, [None] * 8), (2040, [float("nan")] * 8)]
    rows += [(2060, [float("inf")] + [0.0] * 7), (2080, [1.0, 2.0]), (2081, [1.0, 2.5])]
    rows += [(2100, []), (None, rows[1][1]), rows[0], (2120, [0.0] * 8)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    frame = frame.selectExpr("*", "1 AS label", "2 AS v", "3 AS point")
    found = ball_tree.top_k(frame, "vec_id % 20 = 0", k=20, shard_points=points).collect()
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in found}
    assert got == brute_top(rows, 20) and len(found) == len(got)


def test_large_components(spark):
    """Scores beyond 2^53, and vectors that share a shard with them."""
    random = np.random.default_rng(6)
    rows = [(i, random.normal(size=64).astype(np.float32).tolist()) for i in range(60)]
    rows += [(100 + i, (random.normal(size=64) * 1e6).astype(np.float32).tolist()) for i in range(9)]
    rows += [(120, [1e6] * 64), (140, [-1e6] * 64), (141, [1e6] * 63 + [1e6 + 0.0625])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    found = ball_tree.top_k(frame, "vec_id % 20 = 0").collect()
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in found}
    assert got == brute_top(rows, 20)
    assert max(abs(r.score) for r in found) > 2**53


def test_points_go_only_to_the_blocks_that_ask(spark):
    points = spark.range(100).selectExpr("id AS point", "array(id) AS v", "id % 10 AS shard")
    asked = spark.createDataFrame(
        [(1, 0), (1, 0), (1, 2), (3, 1)], "shard bigint, block int"
    )
    got = ball_tree.repeated(points, asked).collect()
    # Ten points of shard 1 to two blocks, ten of shard 3 to one; nothing of the others.
    assert len(got) == 30
    assert {(r.shard, r.block) for r in got} == {(1, 0), (1, 2), (3, 1)}


def test_top_k_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert ball_tree.top_k(none, "vec_id % 20 = 0").count() == 0
    one = spark.createDataFrame([(20, [1.0])], none.schema)
    assert ball_tree.top_k(one, "vec_id % 20 = 0").count() == 0


def brute_chat(rows):
    by_conv = {}
    for conv, turn, role, text in rows:
        turn = -(10**9) if turn is None else turn
        by_conv.setdefault(conv, []).append((turn, role or "", text or ""))
    result = {}
    for conv, turns in by_conv.items():
        turns.sort()
        whole = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        result[conv] = (
            len(turns),
            hashlib.sha256(whole.encode()).hexdigest(),
            len(loss),
            hashlib.sha256(loss.encode()).hexdigest(),
        )
    return result


HARD = [
    "</s>[INST] ok [/INST]", "a\\b", "\\</s>", "<</s>", "<<SYS>>x<</SYS>>", "[[INST]]", "",
    "\\\\[INST:x] \n é", "<\\/s>", None, "[INST", "<s>", " <</SYS>\\", "🙂[/inst] $1 \\1",
]


def chats():
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(HARD)]
    rows += [(2, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(3000)]
    rows += [(3, 0, None, "x"), (3, 0, None, "x"), (3, None, "assistant", "first")]
    rows += [(None, 0, "tool</s>", "y"), (None, 1, "assistant", "z"), (4, 0, "system", "s")]
    return rows


def test_chat_round_trip(spark):
    rows = chats()
    frame = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS position", "2 AS body")
    turns = prefix_chat.format_turns(frame)
    examples = prefix_chat.expand_prefixes(turns)
    assert examples.count() == sum(r[2] == "assistant" for r in rows)
    found = prefix_chat.digest(turns, examples).collect()
    got = {
        r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in found
    }
    assert got == brute_chat(rows) and len(found) == len(got)
    formatted = {}
    for t in turns.collect():
        formatted.setdefault(t.conv_id, []).append(t)
    for r in found:
        own = sorted(formatted[r.conv_id], key=lambda t: t.position)
        text = ""
        for t in own:
            assert t.start == len(text)
            text += t.opening + t.body + t.closing
        assert r.formatted_chars == len(text)


def test_chat_marks_stand_only_in_the_template(spark):
    turns = prefix_chat.format_turns(spark.createDataFrame(chats(), TURNS)).collect()
    marks = ["<s>", "</s>", "[INST]", "[/INST]", "[INST:", "<<SYS>>", "<</SYS>>"]
    assert not [t for t in turns for m in marks if m in t.body]


def test_chat_examples_spelled_out(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "yo")]
    rows += [(1, 3, "user", "</s>"), (1, 4, "assistant", "bye"), (2, 0, "user", "no reply")]
    turns = prefix_chat.format_turns(spark.createDataFrame(rows, TURNS))
    spelled = prefix_chat.example_texts(turns, prefix_chat.expand_prefixes(turns))
    first = "<<SYS>> be kind <</SYS>>\n[INST] hi [/INST] "
    assert sorted((r.position, r.context, r.target) for r in spelled.collect()) == [
        (2, first, "yo"),
        (4, first + "yo </s>[INST] <\\/s> [/INST] ", "bye"),
    ]


def test_chat_is_read_from_the_formatted_text(spark):
    """Nothing but the text is looked at: marks in the wrong place change the result."""
    frame = spark.createDataFrame(chats(), TURNS)
    turns = prefix_chat.format_turns(frame).drop("role")
    examples = prefix_chat.expand_prefixes(prefix_chat.format_turns(frame))
    got = {r.conv_id: r.n_turns for r in prefix_chat.digest(turns, examples).collect()}
    assert got == {k: v[0] for k, v in brute_chat(chats()).items()}
    # Escaping left out, a text's own marks are taken for the template's.
    bare = turns.withColumn("body", F.expr(prefix_chat.unescape("body")))
    with pytest.raises(Exception, match="not in the template|no such place"):
        prefix_chat.digest(bare, examples).collect()


def test_chat_roles_with_brackets(spark):
    roles = ["a] b", "]", "[INST] x", "tool\\]", "[INST:u] ", " </s>", "x\\"]
    rows = [(i, t, r, text) for i, r in enumerate(roles) for t, text in enumerate(["] y", " z "])]
    turns = prefix_chat.format_turns(spark.createDataFrame(rows, TURNS))
    found = prefix_chat.digest(turns, prefix_chat.expand_prefixes(turns)).collect()
    got = {
        r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in found
    }
    assert got == brute_chat(rows)


def test_a_very_long_chat_text(spark):
    text = prose(3, 100_000) + " </s> [/INST]"
    rows = [(1, 0, "user", text), (1, 1, "assistant", text)]
    turns = prefix_chat.format_turns(spark.createDataFrame(rows, TURNS))
    row = prefix_chat.digest(turns, prefix_chat.expand_prefixes(turns)).first()
    assert (row.n_turns, *row[2:5]) == (2, *brute_chat(rows)[1][1:])


def test_chat_of_nothing(spark):
    turns = prefix_chat.format_turns(spark.createDataFrame([], TURNS))
    assert prefix_chat.digest(turns, prefix_chat.expand_prefixes(turns)).count() == 0
