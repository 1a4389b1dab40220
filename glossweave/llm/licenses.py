"""Licences in documents, by known sentences and ordered rules over them.

A document is cut into sentences, each is normalised (letters and digits in lower
case, single blanks) and looked up in a table of known licence sentences.  The known
sentences of a document form a sequence of identifiers; a rule names identifiers that
must follow each other, with a bounded number of other known sentences in between.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, functions as F

from glossweave.llm.common import map_rows, type_of

#: Fixed values: (licence, sentences in order).  Notices have one sentence.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("Released under the MIT License",)),
    ("MIT", ("Licensed under the MIT License",)),
    ("MIT", ("This project is licensed under the MIT License",)),
    ("MIT", ("SPDX-License-Identifier: MIT",)),
    ("MIT", (
        "The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING '
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT",
    )),
    ("Apache-2.0", ("Licensed under the Apache License, Version 2.0",)),
    ("Apache-2.0", ("Released under the Apache License, Version 2.0",)),
    ("Apache-2.0", ("SPDX-License-Identifier: Apache-2.0",)),
    ("Apache-2.0", (
        'Licensed under the Apache License, Version 2.0 (the "License")',
        "you may not use this file except in compliance with the License",
    )),
    ("GPL-3.0", ("This work is licensed under the GNU General Public License, version 3",)),
    ("GPL-3.0", ("Licensed under the GNU General Public License, version 3",)),
    ("GPL-3.0", ("SPDX-License-Identifier: GPL-3.0-or-later",)),
    ("GPL-3.0", ("SPDX-License-Identifier: GPL-3.0-only",)),
    ("GPL-2.0", ("This work is licensed under the GNU General Public License, version 2",)),
    ("GPL-2.0", ("SPDX-License-Identifier: GPL-2.0-only",)),
    ("GPL-2.0", ("SPDX-License-Identifier: GPL-2.0-or-later",)),
    ("LGPL-3.0", ("This work is licensed under the GNU Lesser General Public License, version 3",)),
    ("AGPL-3.0", ("This work is licensed under the GNU Affero General Public License, version 3",)),
    ("MPL-2.0", ("This Source Code Form is subject to the terms of the Mozilla Public License, v",)),
    ("MPL-2.0", ("SPDX-License-Identifier: MPL-2.0",)),
    ("BSD-3-Clause", ("Released under the BSD 3-Clause License",)),
    ("BSD-3-Clause", ("SPDX-License-Identifier: BSD-3-Clause",)),
    ("BSD-2-Clause", ("Released under the BSD 2-Clause License",)),
    ("BSD-2-Clause", ("SPDX-License-Identifier: BSD-2-Clause",)),
    ("ISC", ("Released under the ISC License",)),
    ("ISC", ("SPDX-License-Identifier: ISC",)),
    ("Unlicense", ("This is free and unencumbered software released into the public domain",)),
    ("CC0-1.0", ("Released under CC0 1.0",)),
    ("CC-BY-4.0", ("Licensed under CC BY 4.0",)),
    ("CC-BY-4.0", ("This work is licensed under a Creative Commons Attribution 4.0 International License",)),
    ("CC-BY-SA-4.0", ("Licensed under CC BY-SA 4.0",)),
    ("CC-BY-SA-4.0", (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    )),
    ("CC-BY-NC-4.0", ("Licensed under CC BY-NC 4.0",)),
    ("CC-BY-ND-4.0", ("Licensed under CC BY-ND 4.0",)),
    ("CC-BY-NC-SA-4.0", ("Licensed under CC BY-NC-SA 4.0",)),
    ("All-Rights-Reserved", ("All rights reserved",)),
)
#: Other known sentences that may stand between two sentences of a rule.
GAP = 3
#: A sentence ends at a line break, or at a mark followed by white space.
SPLIT = r"[.;:!?]+[ \t\r\n]+|[\r\n]+"
_SPLIT = re.compile(SPLIT)
_ODD = re.compile(r"[^A-Za-z0-9]+")


def normal(sentence: str) -> str:
    return _ODD.sub(" ", sentence).strip().lower()


def known_sentences(rules: Sequence[tuple[str, tuple[str, ...]]] = RULES) -> dict[str, int]:
    """Identifier of each normalised sentence of the rules, in order of appearance.

    Sentences of the rules are cut like those of documents first: one that holds a mark
    before white space is as many sentences.
    """
    found: dict[str, int] = {}
    for _, sentences in rules:
        for s in sentences:
            for part in _parts(s):
                found.setdefault(part, len(found))
    return found


def _parts(text: str) -> Iterator[str]:
    return (n for n in map(normal, _SPLIT.split(text)) if n)


def sequences(rules: Sequence[tuple[str, tuple[str, ...]]] = RULES, gap: int = GAP) -> list[tuple[str, str]]:
    """(licence, pattern over a sequence written as ``,3,7,12,``) of each rule."""
    ids = known_sentences(rules)
    between = rf"(?:\d+,){{0,{gap}}}"
    return [
        (name, "," + between.join(f"{ids[p]}," for s in sentences for p in _parts(s)))
        for name, sentences in rules
    ]


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: Sequence[tuple[str, tuple[str, ...]]] = RULES,
    gap: int = GAP,
) -> DataFrame:
    """One row per document and licence found: doc_id, license, n_rules, first_sentence.

    n_rules counts the licence's rules that match, first_sentence is the number of the
    first known sentence of the document, from 0, blank sentences not counted.  Null
    and empty texts and texts without a known sentence give no row.  A repeated row
    gives its rows again; an empty table gives none; other columns are ignored.
    """
    ids = known_sentences(rules)
    patterns = [(name, re.compile(p)) for name, p in sequences(rules, gap)]

    def rows(each: Iterable[tuple]) -> Iterator[tuple]:
        for key, text in each:
            hits = [(i, ids[s]) for i, s in enumerate(_parts(text or "")) if s in ids]
            if not hits:
                continue
            written = "," + "".join(f"{i}," for _, i in hits)
            matched: dict[str, int] = {}
            for name, pattern in patterns:
                if pattern.search(written):
                    matched[name] = matched.get(name, 0) + 1
            for name in sorted(matched):
                yield key, name, matched[name], hits[0][0]

    return map_rows(
        docs,
        [F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")],
        f"doc_id {type_of(docs, id_col)}, license string, n_rules int, first_sentence int",
        rows,
    )
