"""Licence scan by patience alignment of texts with licence notices.

A stretch of a text is aligned with a notice on the words that occur once in both: of
those, the longest run in the same order is kept, and the gaps between its members are
aligned in the same way, where words that were not unique before may be. A gap
without such a word is matched from its two ends. The share of the notice's words so
matched is its coverage.

Where to align. A stretch of half as many words again as the notice has must hold, each
as often as the notice does at most, enough of its words to reach the coverage at all;
of stretches that overlap, those with the most are tried first, and the search goes on
before and behind what was found, so a notice given several times is found each time. Before
that, texts without any of a few words of each notice, as many as a notice may miss
and one more, are passed over: they can't reach the coverage either.

Which licence. A notice's marks, the words that name it and its version, must be aligned
without a gap; a text that misses one, or has a word in between, has another licence. Of
two licences' notices where the words of one are nearly all words of the other as
well (nine in ten, with its marks), only the one with more words is found. A notice of one
line says little besides the name, so it is refused where a word that isn't the notice's
stands right before the name ("the X11 MIT License"; articles may), where the name goes on
behind a hyphen ("MIT-0"; ``-only`` and ``-or-later`` may), and where the words in it or the
two before it in its sentence deny it ("not licensed under"). Of an SPDX line the first
licence is found.

Words are runs of letters and digits in lower case. Every text is read whole, in one
pass without a shuffle. Defined cases: null and empty texts and templates find nothing;
a null ``doc_id`` is kept; repeated rows are each scanned; stretches of one notice don't
overlap, those of two notices may; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import frugal, steps
from .license_texts import MARKS, PHRASES, TEMPLATES

COVERAGE = 0.8
# Most words of a notice that is one sentence.
ONE_LINE = 16
# Words before a notice that may deny it.
BEFORE = 2
_WORD = re.compile(r"[^\W_]+")
# Where a sentence ends: a mark and white space, an empty line, a line that starts with a mark.
_BREAK = re.compile(r"[.!?;:]\s|\n\s*\n|\n[^\w\n]*[^\w\s]")

# Words that deny, articles, what may follow a name behind a hyphen.
DENIALS = {"not", "no", "never", "neither", "nor", "cannot", "isn", "aren", "wasn", "weren"}
ARTICLES = {"a", "an", "the"}
SUFFIXES = {"only", "or"}


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _unique(words: list[str], low: int, high: int) -> dict[str, int]:
    """Place of each word that stands once in ``words[low:high]``."""
    places: dict[str, int] = {}
    for i in range(low, high):
        places[words[i]] = -1 if words[i] in places else i
    return {w: i for w, i in places.items() if i >= 0}


def _longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of pairs in order of their first member, the most whose second members rise."""
    tails: list[int] = []
    top: list[int] = []
    before = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        at = bisect_left(tails, b)
        if at == len(tails):
            tails.append(b)
            top.append(i)
        else:
            tails[at], top[at] = b, i
        before[i] = top[at - 1] if at else -1
    chain, i = [], top[-1] if top else -1
    while i >= 0:
        chain.append(pairs[i])
        i = before[i]
    return chain[::-1]


def align(text: list[str], notice: list[str]) -> list[tuple[int, int]]:
    """Matched places ``(in text, in notice)``, rising in both."""
    matched: list[tuple[int, int]] = []
    pending = [(0, len(text), 0, len(notice))]
    while pending:
        a, b, c, d = pending.pop()
        if a >= b or c >= d:
            continue
        in_text, in_notice = _unique(text, a, b), _unique(notice, c, d)
        pairs = sorted((i, in_notice[w]) for w, i in in_text.items() if w in in_notice)
        anchors = _longest_increasing(pairs)
        if anchors:
            matched += anchors
            for i, j in [*anchors, (b, d)]:
                pending.append((a, i, c, j))
                a, c = i + 1, j + 1
            continue
        while a < b and c < d and text[a] == notice[c]:
            matched.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == notice[d - 1]:
            b, d = b - 1, d - 1
            matched.append((b, d))
    return sorted(matched)


class Notice:
    """A template with what the search for it needs."""

    def __init__(
        self, name: str, text: str, coverage: float = COVERAGE, marks: tuple[str, ...] = ()
    ):
        self.name = name
        self.licence = name.split(" (")[0]
        self.phrase = name.endswith((" (terms)", " (under)"))
        self.words = words_of(text)
        self.counts = Counter(self.words)
        self.needed = max(1, -int(-len(self.words) * coverage // 1))
        self.width = len(self.words) + len(self.words) // 2
        # A text that covers enough has one of any so many words; long ones are rare.
        rare = sorted(self.words, key=lambda w: (-len(w), w))
        self.signs = set(rare[: len(self.words) - self.needed + 1])
        self.one_line = len(self.words) <= ONE_LINE
        self.marks = [words_of(m) for m in marks]
        self.must = {w for m in self.marks for w in m}
        # A mark's longest word must be there too, and alone tells more than a few signs.
        named = max(self.must, key=lambda w: (len(w), w), default="")
        if len(named) >= 4:
            self.signs = {named}

    def marked(self, matched: list[tuple[int, int]]) -> list[int] | None:
        """Places in the text of the notice's marks, if all are aligned without a gap.

        The marks are in the notice's order: the first one starts the name.
        """
        places, of = [], {j: i for i, j in matched}
        for mark in self.marks:
            size = len(mark)
            for at in range(len(self.words) - size + 1):
                if self.words[at : at + size] == mark and at in of:
                    own = list(range(of[at], of[at] + size))
                    if [of.get(at + x) for x in range(size)] == own:
                        places += own
                        break
            else:
                return None
        return places

    def find(self, text: list[str]) -> list[tuple[int, int, int, set, list]]:
        """``(start, end, matched, places, marks)`` of each stretch that covers enough.

        ``places`` are those of the matched words in the text, ``marks`` those of the marks.
        """
        places = [i for i, w in enumerate(text) if w in self.counts]
        result, pending = [], [(0, len(places))]
        while pending:
            low, high = pending.pop()
            for group in self._dense(text, places, low, high):
                hits = (self._found(text, places[at], places[high - 1] + 1) for at in group)
                hit = next((x for x in hits if x is not None), None)
                if hit is not None:
                    result.append(hit)
                    before = bisect_left(places, hit[0], low, high)
                    pending.append((min(group), before))
                    pending.append((bisect_left(places, hit[1], low, high), high))
                    break
        return sorted(result, key=lambda x: x[:2])

    def _found(self, text: list[str], start: int, stop: int) -> tuple | None:
        """What is found in the stretch from ``start``, of words before ``stop``."""
        matched = align(text[start : min(start + self.width, stop)], self.words)
        marks = self.marked(matched) if len(matched) >= self.needed else None
        if marks is None:
            return None
        places = {start + i for i, _ in matched}
        own = [start + i for i in marks]
        head, last = start + matched[0][0], start + matched[-1][0] + 1
        if self.one_line and own and own[0] > head:
            if own[0] - 1 not in places and text[own[0] - 1] not in ARTICLES:
                return None
        return head, last, len(matched), places, own

    def _dense(
        self, text: list[str], places: list[int], low: int, high: int
    ) -> Iterator[list[int]]:
        """Groups of overlapping stretches that hold enough words, the best of each first.

        Stretches start and end at ``places[low:high]``.
        """
        held: Counter = Counter()
        good, end, best = 0, low, None
        group: list[tuple[int, int]] = []
        for at in range(low, high):
            if best is not None and places[at] >= places[best[1]] + self.width:
                yield [x for _, x in sorted(group)]
                best, group = None, []
            while end < high and places[end] < places[at] + self.width:
                word = text[places[end]]
                held[word] += 1
                good += held[word] <= self.counts[word]
                end += 1
            if good >= self.needed:
                group.append((-good, at))
                if best is None or good > best[0]:
                    best = (good, at)
            word = text[places[at]]
            good -= held[word] <= self.counts[word]
            held[word] -= 1
        if group:
            yield [x for _, x in sorted(group)]


def refused(text: str, found: list[tuple]) -> list[tuple]:
    """Of ``(notice, start, end, matched, places, marks)``, the lines that are no licence."""
    lines = [x for x in found if x[0].one_line]
    if not lines:
        return []
    spans = [m.span() for m in _WORD.finditer(text)]
    result = []
    for x in lines:
        _, start, end, _, _, marks = x
        low = start
        while low > max(0, start - BEFORE):
            if _BREAK.search(text, spans[low - 1][1], spans[low][0]):
                break
            low -= 1
        denied = any(text[a:b] in DENIALS for a, b in spans[low:end])
        last = marks[-1] if marks else end - 1
        goes_on = (
            last + 1 < len(spans)
            and text[spans[last][1] : spans[last + 1][0]] == "-"
            and text[slice(*spans[last + 1])] not in SUFFIXES
        )
        if denied or goes_on:
            result.append(x)
    return result


def own_finds(found: list[tuple]) -> list[tuple]:
    """Of ``(notice, start, end, matched, places, marks)``, those no other licence explains.

    A phrase within a notice of the same licence says nothing new either.
    """
    left = []
    for x in found:
        n, start, end, matched, places, marks = x
        if n.phrase and any(
            y[0].licence == n.licence and not y[0].phrase and y[1] < end and start < y[2]
            for y in found
        ):
            continue
        if not any(
            y[0].licence != n.licence
            and (y[3], y[3] / len(y[0].words)) > (matched, matched / len(n.words))
            and y[1] < end
            and start < y[2]
            and len(places & y[4]) * 10 >= len(places) * 9
            and y[4].issuperset(marks)
            for y in found
        ):
            left.append(x)
    return left


def scan(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    coverage: float = COVERAGE,
    marks: dict[str, tuple[str, ...]] | None = None,
) -> DataFrame:
    """``doc_id, license, start, end, n_matched, coverage`` of each notice in each text.

    ``start`` and ``end`` count the text's words. ``marks`` are phrases of the templates that
    must be found whole, by name; without any given, templates by default names have theirs.
    """
    known = TEMPLATES | PHRASES
    templates = known if templates is None else templates
    if marks is None:
        marks = {n: MARKS.get(n, ()) for n, t in templates.items() if known.get(n) == t}
    notices = [Notice(n, t, coverage, marks.get(n, ())) for n, t in templates.items()]
    notices = [n for n in notices if n.words]
    signs = sorted({w for n in notices for w in n.signs})
    pattern = "|".join(re.escape(w) for w in signs) or r"[^\s\S]"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in steps(batch.column("text")):
                texts = batch.column("text").slice(a, b - a)
                likely = pc.match_substring_regex(pc.utf8_lower(texts), pattern)
                rows = []
                for i in pc.indices_nonzero(likely).to_pylist():
                    text = texts[i].as_py().lower()
                    words = words_of(text)
                    there = set(words)
                    found = []
                    for n in notices:
                        if n.signs & there and n.must <= there:
                            found += [(n, *x) for x in n.find(words)]
                    lines = refused(text, found)
                    found = [x for x in found if x not in lines]
                    rows += [(a + i, *x[:4]) for x in own_finds(found)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").take(
                            pa.array([r[0] for r in rows], pa.int64())
                        ),
                        "license": pa.array([r[1].name for r in rows], pa.string()),
                        "start": pa.array([r[2] for r in rows], pa.int64()),
                        "end": pa.array([r[3] for r in rows], pa.int64()),
                        "n_matched": pa.array([r[4] for r in rows], pa.int64()),
                        "coverage": pa.array(
                            [r[4] / len(r[1].words) for r in rows], pa.float64()
                        ),
                    }
                )

    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return rows.mapInArrow(
        frugal(search),
        "doc_id bigint, license string, start bigint, end bigint, n_matched bigint, "
        "coverage double",
    )
