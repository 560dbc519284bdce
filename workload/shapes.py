"""Line shapes that the events table is turned into, for Spark and for SQL alike.

``<d>`` date, ``<t>`` time, ``<f>`` milliseconds, ``<m>`` month name, ``<dd>`` day,
``<md>`` month-day, ``<u>`` user, ``<one>`` last digit of the user, ``<h>`` user modulo
7, ``<id>`` event, ``<type>`` event type, ``<lvl>`` level word, ``<mark>`` logcat letter,
``<props>`` properties.
"""

from __future__ import annotations

import re

# Level word and logcat letter of each event type.
LEVEL_WORDS = {"error": "ERROR", "signup": "WARN", "purchase": "INFO", "view": "DEBUG"}
OTHER_WORD = "note"
LETTERS = {"error": "E", "signup": "W", "purchase": "I", "view": "D"}
OTHER_LETTER = "V"

# One log file per format.
FILES = {
    "app.log": "<d> <t>.<f> <lvl> user=<u> <props>",
    "device.log": "<md> <t>.<f>  <u>  <id> <mark> Tag: <type>",
    "sys.txt": "<m> <dd> <t> host<h> app[<id>]: <lvl>",
    "svc.jsonl": '{"ts":"<d>T<t>.<f>Z","level":"<lvl>","msg":"<type>"}',
}

# Shapes the four regular files do not reach. An event takes the
# one at its number modulo their count.
ODD_SHAPES = [
    "<d>T<t>.<f>Z <lvl> x",
    "<d>T<t>+05:30 <type>",
    "<d>T<t>.<f>-08:00|<lvl>",
    "<d>T<t>+05:3 <lvl>",
    "<d>T<t>.<f>x bad fraction",
    "<d>T<t>. dot only",
    "<d>T<t>Zulu <type>",
    "<d> <t>.<f> <lvl> <type>",
    "\t  <d> <t> <lvl> user=<u>",
    "<d> <t><id> digits follow",
    "<m> <dd> <t> host proc: <lvl>",
    "<m>  <one> <t> host proc: <type>",
    "<m>  <one> <t>",
    "<m> <one> <t>",
    "<m> <one> <t>!",
    "<m>  x<one> <t> host proc: <lvl>",
    "<t>.<f> <type> terror",
    "<t>:extra information",
    "  <t> wide spaces <lvl>",
    "é<d> <t> accent first",
    "<md> <t>.<f> <u> <id> W Tag: <type>",
    "<md> <t>.<f>  <u>  <id> EE Tag: two letters",
    "<md> <t>.<f>\t<u> <id> F Tag",
    "<md> <t>.<f>",
    "<md> <t>.<f>x <u> <id> I Tag",
    "<md> <t>.1X3 rest",
    "--------- beginning of main <id>",
    "  <md> <t>.<f> <u> <id> V",
    "<md> <t>.<f> <u> <id> Q Tag",
    "<m> <dd> <t> error-host myproc[<id>]: disk space warning",
    "<m> <dd> <t> host p:<id> no message trace",
    "<m> <dd> <t> : <lvl>: tail debug",
    "<m> <dd> <t>-05 host p: msg",
    "<m> <dd> <t> info-host p[<id>]:    padded <type>",
    '{"time":"<d>T<t>Z","level":50,"msg":"<type>"}',
    '{"@timestamp":"<t>", "severity" : "<lvl>", "n":<id>}',
    '{"level":<one>5,"ts":"","time":7}',
    '{"msg":"say \\"level\\":\\"error\\"","lvl":"Fatal <id>"}',
    '{"a":["x","level"],"b":"q","msg":"<type>"}',
    '{"level":true,"severity":"warning","timestamp":"<t>"}',
    '  {"ts":5,"time":"<d>","level":" +00<u> "}  ',
    '[{"level":"error","ts":"<t>"}]',
    '{"level":"crit',
    '{"level":18446744073709551616,"lvl":"verbose"}',
    '{"level":18446744073709551615,"lvl":"error","msg":"<type>"}',
    '{"level":4294967295,"msg":"a\\\\"}',
    '{"level":4294967296,"lvl":"error","msg":"open \\"}',
    '{"level":000<id>,"msg":"\\\\","ts":"a\\tb"}',
    '{"x":{ "level" : "inner" }, "level":"ERROR"}',
    '{"msg":"level","level" 1}',
    "ERROR in info handler <id>",
    "TRACE only <id>",
    "Debugging <type>",
    "plain words <id>",
    "",
]


def pieces(shape: str) -> list[tuple[str, str]]:
    """``("field", name)`` and ``("text", literal)`` parts of a shape, in order."""
    parts = []
    for part in re.split(r"(<[a-z]+>)", shape):
        if re.fullmatch(r"<[a-z]+>", part):
            parts.append(("field", part[1:-1]))
        elif part:
            parts.append(("text", part))
    return parts
