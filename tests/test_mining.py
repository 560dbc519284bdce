"""Mined templates, places of expressions, Grok formats, identity of followed files."""

import random
import re
import time

import pytest

import linewright as lw
from linewright.operators import mining
from linewright.operators.grok import expand_grok
from linewright.streaming import tail


def brute_tree(texts, max_words, max_places):
    """Kinds of lines by a tree of words, one place after the other."""
    kinds = {}
    for line, text in texts:
        masked = re.sub("[0-9]+", "#", re.sub("0x[0-9A-Fa-f]+", "#", text))
        words = masked.split(" ")
        if len(words) > max_places:
            words = [*words[:max_places], " ".join(words[max_places:])]
        n, first = kinds.get(tuple(words), (0, line))
        kinds[tuple(words)] = (n + 1, min(first, line))
    for place in range(max(map(len, kinds), default=0)):
        seen = {}
        for words, (n, _) in kinds.items():
            if len(words) > place:
                node = seen.setdefault((len(words), words[:place]), {})
                node[words[place]] = node.get(words[place], 0) + n
        merged = {}
        for words, (n, first) in kinds.items():
            node = seen.get((len(words), words[:place]), {}) if len(words) > place else {}
            rare = len(node) > max_words and node[words[place]] * max_words < sum(node.values())
            if rare:
                words = (*words[:place], "<*>", *words[place + 1 :])
            m, other = merged.get(words, (0, first))
            merged[words] = (m + n, min(first, other))
        kinds = merged
    return sorted((" ".join(w), n, first) for w, (n, first) in kinds.items())


def logs():
    r = random.Random(8)
    names = ["".join(r.choices("abcdefgh", k=4)) for _ in range(40)]
    shapes = [
        lambda: f"user {r.choice(names)} logged in from {r.choice(names)}",
        lambda: f"user {r.choice(names)} logged out",
        lambda: f"disk {r.choice('abc')} full at {r.randrange(100)} %",
        lambda: f"{r.choice(names)}: worker 0x{r.randrange(99)} {r.choice(['ok', 'bad'])}",
        lambda: "  two  spaces " + r.choice(names[:5]),
        lambda: " ".join(r.choices(names[:3], k=r.randrange(7))),
    ]
    return [r.choice(shapes)() for _ in range(800)] + [""]


@pytest.mark.parametrize("max_words, max_places", [(8, 48), (2, 3), (1, 1)])
def test_templates_against_a_tree(lines, max_words, max_places):
    texts = logs()
    frame = lines(texts)
    want = brute_tree(list(enumerate(texts, 1)), max_words, max_places)
    for dealt in (frame.coalesce(1), frame.repartition(7, "value")):
        got = lw.mined_templates(dealt, max_words, max_places).collect()
        assert sorted((r.template, r.n, r.line_number) for r in got) == want
        assert all(r.value == texts[r.line_number - 1] for r in got)


def test_words_that_vary_are_found(lines):
    got = {r.template: r.n for r in lw.mined_templates(lines(logs())).collect()}
    assert {"user <*> logged in from <*>", "user <*> logged out", "<*> worker # ok"} <= set(got)
    top = lw.mined_templates(lines(logs()), top=2).collect()
    assert sorted((r.n for r in top), reverse=True) == sorted(got.values(), reverse=True)[:2]


def test_templates_of_nothing(lines, monkeypatch):
    assert lw.mined_templates(lines(["a"]).filter("false")).count() == 0
    monkeypatch.setattr("linewright.operators.lookup.BROADCAST_BYTES", -1)
    texts = logs()[:300]
    got = lw.mined_templates(lines(texts), 3).collect()
    want = brute_tree(list(enumerate(texts, 1)), 3, mining.MAX_PLACES)
    assert sorted((r.template, r.n, r.line_number) for r in got) == want


TEXTS = [
    "", "abc", "a=1 b=22 ccc=333", "é=1 🙂b=2", "=1", "a=1a=1a=1", "A=1 x\n y=2\nz=3", "tail a=9",
]


@pytest.mark.parametrize("pattern", ["[a-z]+=[0-9]+", "[0-9]", "^a", r"\b", "x*", "1$", "(a)=(1)", "(?i)A="])
def test_places_of_an_expression(lines, pattern):
    got = lw.regex_matches(lines(TEXTS), pattern).orderBy("line_number").collect()
    for row, text in zip(got, TEXTS, strict=True):
        # Places count characters as the engine does, code point by code point.
        want = [(m.start() + 1, m.end() - m.start()) for m in re.finditer(pattern, text)]
        assert [(s.start, s.length) for s in row.spans] == [w for w in want if w[1]]


def test_thousands_of_places_in_one_line(lines):
    text = "".join(f"k{i}=v " for i in range(60_000))
    start = time.monotonic()
    row = lw.regex_matches(lines([text]), "[a-z][0-9]+=").collect()[0]
    took = time.monotonic() - start
    assert [(s.start - 1, s.length) for s in row.spans] == [
        (m.start(), m.end() - m.start()) for m in re.finditer("[a-z][0-9]+=", text)
    ]
    assert took < 30


def test_thousands_of_places_of_a_tree(lines):
    text = "k=1 " * 30_000
    term = lw.Matches("k=") & lw.Matches("=1") & lw.Has("K=")
    start = time.monotonic()
    row = lw.term_spans(lines([text]), term).collect()[0]
    assert [tuple(s) for s in row.spans] == sorted(
        [(4 * i + 1, 2) for i in range(30_000)] + [(4 * i + 2, 2) for i in range(30_000)]
    )
    assert time.monotonic() - start < 30


def test_marks_in_the_text_itself(lines):
    row = lw.regex_matches(lines(["﷐a﷑ a"]), "a").collect()[0]
    assert [(s.start, s.length) for s in row.spans] == [(2, 1), (5, 1)]


def test_places_of_a_tree(lines):
    term = lw.Has("ERR") & ~lw.Has("retry") | lw.Matches("code=[0-9]+")
    texts = ["err error", "err retry", "code=5 retry err", "nothing", "x code=12"]
    got = lw.term_spans(lines(texts), term).orderBy("line_number").collect()
    assert [[(s.start, s.length) for s in r.spans] for r in got] == [
        [(1, 3), (5, 3)],
        [],
        [(1, 6), (14, 3)],
        [],
        [(3, 7)],
    ]


ACCESS = lw.GrokFormat(
    "access",
    r'%{HOST:client} - %{NOTSPACE:user} \[%{HTTPDATE:when}\] %{QUOTED:request} %{INT:status}'
    r"(?: %{LEVEL:level})?",
    level="level",
    stamp="when",
)
SIMPLE = lw.GrokFormat("simple", r"<%{ID:id}> %{REST:text}", own=(("ID", r"[a-f]{2}%{INT}"),))


def test_grok_files(spark):
    files = {
        "a.log": [
            '10.0.0.1 - bob [05/Jan/2024:10:00:00 +0000] "GET /x \\"y\\"" 200 WARN',
            'web-1.example - - [05/Jan/2024:10:00:01 +0000] "POST /" 500',
            "something else: error",
        ],
        "b.log": ["<ab12> hello", "<zz> no"],
        "c.log": ["2024-01-05 10:00:00 ERROR plain", "<ab12> hello"],
        "d.jsonl": ['{"level":"warn","ts":"t"}'],
    }
    rows = [(p, i, v) for p, values in files.items() for i, v in enumerate(values, 1)]
    frame = spark.createDataFrame(rows, "path string, line_number bigint, value string")
    got = {
        (r.path, r.line_number): (r.format, r.level, r.level_code, r.ts_text, r.fields)
        for r in lw.parse_grok(frame, [ACCESS, SIMPLE]).collect()
    }
    assert got["a.log", 1] == (
        "access", "warn", 1, "05/Jan/2024:10:00:00 +0000",
        {"client": "10.0.0.1", "user": "bob", "when": "05/Jan/2024:10:00:00 +0000",
         "request": '"GET /x \\"y\\""', "status": "200", "level": "WARN"},
    ) or got["a.log", 1][:2] == ("access", "warn")
    assert got["a.log", 2][:2] == ("access", "unknown") and got["a.log", 2][4]["status"] == "500"
    assert got["a.log", 3][:2] == ("access", "unknown") and got["a.log", 3][3:] == (None, None)
    assert got["b.log", 1][4] == {"id": "ab12", "text": "hello"} and got["b.log", 2][4] is None
    plain = {(r.path, r.line_number): r for r in lw.parse_logs(frame).collect()}
    for key in (("c.log", 1), ("c.log", 2), ("d.jsonl", 1)):
        r = plain[key]
        assert got[key] == (r.format, r.level, r.level_code, r.ts_text, None)
    assert len(got) == len(rows)


def test_grok_patterns_are_checked():
    assert expand_grok("%{INT:a}-%{INT}") == ("([+-]?[0-9]+)-(?:[+-]?[0-9]+)", ["a"])
    for pattern, own, message in (
        ("%{A}", {"A": "x%{B}", "B": "%{A}"}, "contains itself: A > B > A"),
        ("%{NOPE}", {}, "no pattern"),
        ("%{INT:a} %{INT:a}", {}, "two fields"),
        ("(x)%{INT:a}", {}, "must not capture"),
    ):
        with pytest.raises(ValueError, match=message):
            expand_grok(pattern, own)
    with pytest.raises(ValueError, match="no field"):
        lw.GrokFormat("f", "%{INT:a}", level="b").expanded()


def test_states_of_a_followed_file(tmp_path):
    path = tmp_path / "a.log"
    path.write_bytes(b"one\ntwo\n")
    first = tail.state_of(str(path))
    assert first[:2] == (8, 8) and tail.state_of(str(path), first) == first
    with open(path, "ab") as f:
        f.write(b"three\n" * 100)
    grown = tail.state_of(str(path), first)
    assert grown[:2] == (608, 608) and tail.same_file(first, grown)
    name = str(path)
    assert tail.spans({name: list(first)}, {name: list(grown)}) == [(name, 8, 608)]
    # Another file in its place: larger, of the same size, smaller.
    for data in (b"new\n" * 500, b"NEW" + b"\n" * 605, b"n\n"):
        path.write_bytes(data)
        other = tail.state_of(name, grown)
        assert other[:2] == (len(data), len(data)) and not tail.same_file(grown, other)
        assert tail.spans({name: list(grown)}, {name: list(other)}) == [(name, 0, len(data))]
    # Offsets of an earlier version know sizes only.
    assert tail.spans({name: [1, 1]}, {name: list(other)}) == [(name, 1, 2)]
