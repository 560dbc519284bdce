"""Spark expressions against independent SQL in another engine."""

import random

import pytest

import __spark_entry__ as app
from linewright import functions as lf
from linewright.operators.parse import parse_logs
from workload import oracle
from workload.oracle import ORACLE
from workload.queries import QUERIES

duckdb = pytest.importorskip("duckdb")

SF = "/root/testdata/sf0.001"
SEEDS = [
    "2024-01-15T14:23:05.123+05:30 ERROR x",
    "2024-01-15 14:23:05.456 warn",
    "Jan  5 14:23:05 host p[1]: Info",
    "Jan 15 14:23:05 error-host p: msg debug: trace",
    "14:23:05.9 text",
    "05-28 14:23:05.123  12  34 I Tag: m",
    "--------- beginning of main",
    '{"timestamp":"t\\"x","level":"warn","n":30}',
    '{"time" : 5, "ts":"", "level": 60 , "lvl":"crit"}',
    '{"a":{"severity":"42"},"level":18446744073709551615}',
]
ALPHABET = "0123456789:-.TZ+ \t  \u0085\x0bé{}[],\"\\EWIDVFerrorwanifo"


def mutated(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        text = list(rng.choice(SEEDS))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(text) + 1)
            kind = rng.randrange(4)
            if kind == 0:
                text.insert(at, rng.choice(ALPHABET))
            elif kind == 1 and text:
                del text[min(at, len(text) - 1)]
            elif kind == 2 and text:
                text[min(at, len(text) - 1)] = rng.choice(ALPHABET)
            else:
                text = text[:at]
        texts.append("".join(text))
    return texts


def test_mutated_lines(spark, lines):
    texts = mutated(20240115, 6000)
    frame = lines(texts)
    con = duckdb.connect()
    con.execute("CREATE TABLE l (line_number BIGINT, value VARCHAR)")
    con.executemany("INSERT INTO l VALUES (?, ?)", list(enumerate(texts, start=1)))
    json = parse_logs(frame, "JSON")
    pairs = {
        "plain_ts": (lf.plain_timestamp("value"), oracle.TS_PLAIN),
        "logcat_ts": (lf.logcat_timestamp("value"), oracle.TS_LOGCAT),
        "syslog_ts": (lf.syslog_timestamp("value"), oracle.TS_SYSLOG),
        "json_ts": (lf.json_timestamp("value"), oracle.TS_JSON),
        "message": (lf.syslog_message("value"), oracle.MESSAGE),
        "keyword": (lf.keyword_level("value"), oracle.LEVEL_PLAIN),
        "syslog": (lf.syslog_level("value"), oracle.LEVEL_SYSLOG),
        "logcat": (lf.logcat_level("value"), oracle.LEVEL_LOGCAT),
        "json": (json.level, oracle._value_level("jv")),
        "text": (lf.string_field("value", "level"), oracle.json_string("level")),
        "number": (
            lf.number_field("value", "level").cast("string"),
            oracle.json_number("level"),
        ),
    }
    got = json.select("line_number", *[c.alias(n) for n, (c, _) in pairs.items()])
    got = [tuple(r) for r in got.orderBy("line_number").collect()]
    columns = ", ".join(f"{q} AS {n}" for n, (_, q) in pairs.items())
    want = con.execute(
        f"WITH t AS (SELECT *, {oracle.TRIM} AS s FROM l), "
        f"j AS (SELECT *, {oracle.LEVEL_VALUE} AS jv FROM t) "
        f"SELECT line_number, {columns} FROM j ORDER BY line_number"
    ).fetchall()
    differing = [(texts[g[0] - 1], g, w) for g, w in zip(got, want) if g != w]
    assert differing[:3] == []
    assert len(got) == len(texts)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(app.queries()) >= set(app.oracle_sql()) >= set(QUERIES)


@pytest.mark.parametrize(
    "name", ["parse_logs", "search_counts", "match_page", "match_spans", "scan_lines"]
)
def test_registered_query(spark, name):
    con = duckdb.connect()
    for table in ("events", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    frame = app.queries()[name](spark, SF)
    order = sorted(frame.columns)
    got = sorted(tuple(str(r[c]) for c in order) for r in frame.collect())
    cursor = con.execute(f"SELECT {', '.join(order)} FROM ({app.oracle_sql()[name]})")
    assert got == sorted(tuple(map(str, r)) for r in cursor.fetchall())


def test_entry(spark):
    rows = app.entry(spark).collect()
    assert {r.path for r in rows} == {"app.log", "device.log", "sys.txt", "svc.jsonl"}
