import random

import pytest

from linewright.llm.license_texts import MARKS, PHRASES, TEMPLATES
from linewright.llm.patience import Notice, align, own_finds, scan, words_of

from .conftest import prose

ALL = TEMPLATES | PHRASES
NOTICES = [Notice(n, t, marks=MARKS.get(n, ())) for n, t in ALL.items()]


def licences(text):
    words = words_of(f"{prose(1, 30)} {text} {prose(2, 30)}")
    found = [(n, *x) for n in NOTICES if n.must <= set(words) for x in n.find(words)]
    return {x[0].licence for x in own_finds(found)}


@pytest.mark.parametrize("name", list(ALL))
def test_every_notice_gives_its_licence_only(name):
    assert licences(ALL[name]) == {name.split(" (")[0]}


@pytest.mark.parametrize(
    "line, want",
    [
        ("Released under the BSD License.", {"BSD"}),
        ("Released under the Zlib License.", set()),
        ("Licensed under CC BY 4.0.", {"CC-BY-4.0"}),
        ("Licensed under CC BY-SA 4.0.", {"CC-BY-SA-4.0"}),
        ("Licensed under CC BY-NC-SA 4.0.", {"CC-BY-NC-SA-4.0"}),
        ("Licensed under CC BY-NC 2.5.", set()),
        ("Licensed under the Apache License, Version 1.1.", set()),
        ("Licensed under the Eclipse License, Version 2.0.", set()),
        ("This work is licensed under the GNU General Public License, version 2.", {"GPL-2.0"}),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", {"LGPL-3.0"}),
        ("This work is licensed under the GNU General Public License, version 1.", set()),
        ("Licensed under the Apache License, Version 2.0. Released under the MIT License.",
         {"Apache-2.0", "MIT"}),
    ],
)
def test_lines_of_other_licences(line, want):
    assert licences(line) == want


def test_gnu_headers_by_version():
    text = TEMPLATES["GPL-3.0"]
    assert licences(text.replace("version 3", "version 1")) == set()
    assert licences(text.replace("GNU General", "GNU Library General")) == set()


def test_scan_names_the_right_licence(docs):
    lines = ["Licensed under CC BY-SA 4.0.", TEMPLATES["BSD-3-Clause"]]
    found = scan(docs(list(enumerate(lines)))).collect()
    assert {(r.doc_id, r.license) for r in found} == {
        (0, "CC-BY-SA-4.0 (short)"), (1, "BSD-3-Clause"),
    }


def brute_force(notice, text):
    """``(start, end)`` of what every single stretch that starts in a notice's word gives."""
    found = set()
    for i, word in enumerate(text):
        if word in notice.counts:
            hit = notice._found(text, i, len(text))
            if hit is not None:
                found.add(hit[:2])
    return found


def garbled(rng, text):
    """A notice with some words gone, changed, added or moved."""
    words = text.split()
    for _ in range(rng.randrange(max(1, len(words) // 3))):
        at = rng.randrange(len(words))
        kind = rng.randrange(4)
        if kind == 0 and len(words) > 1:
            del words[at]
        elif kind == 1:
            words[at] = "other"
        elif kind == 2:
            words.insert(at, rng.choice(words))
        else:
            words.insert(rng.randrange(len(words)), words.pop(at))
    return " ".join(words)


@pytest.mark.parametrize("seed", range(30))
def test_search_misses_no_stretch(seed):
    rng = random.Random(seed)
    names = rng.sample(sorted(ALL), 3)
    parts = []
    for _ in range(6):
        parts.append(garbled(rng, ALL[rng.choice(names)]))
        if rng.random() < 0.5:
            parts.append(prose(rng.randrange(1000), rng.randrange(20)))
    text = words_of(" ".join(parts))
    for notice in NOTICES:
        if notice.name not in names:
            continue
        want, got = brute_force(notice, text), [x[:2] for x in notice.find(text)]
        assert all(any(a < d and c < b for c, d in got) for a, b in want)
        assert all(b <= c for (_, b), (c, _) in zip(got, got[1:]))
        assert bool(want) == bool(got)
        for start, end in got:
            matched = len(align(text[start:end], notice.words))
            assert matched >= notice.needed and end - start <= notice.width


def test_a_worse_copy_beside_a_better_one():
    line = words_of(TEMPLATES["MIT (short)"])
    notice = Notice("MIT (short)", TEMPLATES["MIT (short)"], marks=MARKS["MIT (short)"])
    for text in (line[1:] + line, line + line[1:], line[1:] + line + line[1:]):
        assert len(notice.find(text)) == text.count("mit")


@pytest.mark.parametrize(
    "line, want",
    [
        ("This is not licensed under the MIT License.", set()),
        ("It isn't released under the MIT License.", set()),
        ("This work is not licensed under the GNU General Public License, version 3.", set()),
        ("Released, but never under the MIT License.", set()),
        ("This is not. Released under the MIT License.", {"MIT"}),
        ("# DO NOT EDIT\n# Released under the MIT License.", {"MIT"}),
        ("Released under the MIT License. Not for sale.", {"MIT"}),
        ("Released under the X11 MIT License.", set()),
        ("Released under MIT License.", {"MIT"}),
        ("Released under the terms of the MIT License.", {"MIT"}),
        ("SPDX-License-Identifier: MIT", {"MIT"}),
        ("// SPDX-License-Identifier: MIT-0\nint x;", set()),
        ("SPDX-License-Identifier: MIT OR Apache-2.0", {"MIT"}),
        ("SPDX-License-Identifier: GPL-2.0-only", {"GPL-2.0"}),
        ("SPDX-License-Identifier: LGPL-3.0-or-later", {"LGPL-3.0"}),
        ("SPDX-License-Identifier: BSD-3-Clause-Clear", set()),
        ("SPDX-License-Identifier: CC-BY-SA-4.0", {"CC-BY-SA-4.0"}),
        ("under the terms of the Apache-2.0 license", {"Apache-2.0"}),
        ("available under the Apache 2.0 License, see there", {"Apache-2.0"}),
        ("it is not under the Apache 2.0 License", set()),
        ("compatible with the Apache 2.0 License", set()),
    ],
)
def test_lines_that_say_otherwise(docs, line, want):
    text = f"{prose(1, 30)}.\n{line}\n\n{prose(2, 30)}"
    rows = scan(docs([(1, text)])).collect()
    assert {r.license.split(" (")[0] for r in rows} == want
    assert len(rows) == len(want)
