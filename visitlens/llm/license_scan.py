"""Licence scan: template mark-up compiled into token automata.

A template is a text with mark-up: ``[...]`` may be absent, ``(a|b)`` is one of
several wordings, ``{n}`` is replaceable - any 0 to n words.  The rest is
mandatory.  It compiles into an automaton over words; a place in a document is
accepted when the words from there take the automaton to its end, so the
mandatory wording has to match exactly, word for word.

Base phrases (plain runs of words) are found beside the templates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Base phrases and their labels.
BASE_PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Words that licences put in quotes: ASCII marks separate words, others are part of them.
_AS_IS = "(as is|“as is”)"
_SOFTWARE = "(software|“software”)"
_LICENSE = "(license|“license”)"
_HOLDER = "[copyright {16}] "
_MIT = (f"{_HOLDER}permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        f"documentation files the {_SOFTWARE} to deal in the software without restriction including without limitation the rights to "
        "use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the "
        "software is furnished to do so subject to the following conditions the above copyright notice and this permission notice "
        "[including the next paragraph] shall be included in all copies or substantial portions of the software the software is "
        f"provided {_AS_IS} without warranty of any kind express or implied including but not limited to the warranties of "
        "merchantability fitness for a particular purpose and (noninfringement|non infringement) in no event shall ")
_MIT_END = (" be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of "
            "or in connection with the software or the use or other dealings in the software")

_TERMS = "you can redistribute it and or modify it under the terms of the "
_FSF = " general public license as published by the free software foundation "
_LATER = "either version {2} of the license or at your option any later version"
_HOPE = ("[this (program|library|software) is distributed in the hope that it will be useful but without any warranty without even the implied "
         "warranty of merchantability or fitness for a particular purpose see the gnu {1} general public license for more details]")
_FREE = "this (program|library|software) is free software "
_VERBATIM = "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"

# Identifiers of licences and of exceptions in expressions, as words.
SPDX_IDS = tuple("""mit|x11|isc|zlib|unlicense|0bsd|apache 2 0|mpl 2 0|epl 2 0|bsl 1 0|cc0 1 0|bsd 2 clause|bsd 3 clause|cc by 4 0|cc by sa 4 0|
    gpl 2 0|gpl 3 0|gpl 2 0 only|gpl 3 0 only|gpl 2 0 or later|gpl 3 0 or later|lgpl 2 1|lgpl 3 0|lgpl 2 1 only|lgpl 3 0 only|
    lgpl 2 1 or later|lgpl 3 0 or later|agpl 3 0|agpl 3 0 only|agpl 3 0 or later""".replace("\n    ", "").split("|"))
SPDX_EXCEPTIONS = "(classpath exception 2 0|gcc exception 3 1|llvm exception|linux syscall note|autoconf exception 3 0|bison exception 2 2|font exception 2 0)"
#: Further licences of an expression before and after the one that a template names.
SPDX_TERMS = 2


def spdx_label(words: str) -> str:
    """``gpl 2 0 or later`` as an identifier: numbers joined by a point."""
    return re.sub(r"(?<=\d)-(?=\d)", ".", words.replace(" ", "-"))


def spdx_templates(ids: tuple[str, ...] = SPDX_IDS, terms: int = SPDX_TERMS) -> list[tuple[str, str]]:
    """A template per identifier: expressions (AND, OR, WITH) that name it, whatever
    other licences stand before and after it."""
    exception = f"[with {SPDX_EXCEPTIONS}]"
    other = f"({'|'.join(ids)}) {exception}"
    before = after = ""
    for _ in range(terms):
        before, after = f"[{other} (and|or) {before}]", f"[(and|or) {other} {after}]"
    return [(spdx_label(i), f"spdx license identifier {before} {i} {exception} {after}") for i in ids]


# Wording of notices and, over their whole length, of licences, with mark-up.
TEMPLATES = (
    ("mit", "(released|licensed|distributed|available|published) under [the terms of] (the|an) mit license"),
    ("mit", _MIT + "the (authors|author) or copyright (holders|holder)" + _MIT_END),
    ("x11", _MIT + "the {8}" + _MIT_END + " except as contained in this notice the (name|names) of {12} shall not be used in advertising "
            "or otherwise to promote the sale use or other dealings in this software without prior written authorization [from {8}]"),
    ("apache-2.0", "(released|licensed|distributed|available|published) under [the terms of] the apache license version 2 0 "
                   f"[the {_LICENSE}]"),
    ("apache-2.0", "you may not use this file except in compliance with the license [you may obtain a copy of the license at {12}] "
                   "unless required by applicable law or agreed to in writing software distributed under the license is "
                   f"distributed on an {_AS_IS} basis without warranties or conditions of any kind either express or implied see the "
                   "license for the specific language governing permissions and limitations under the license"),
    ("gpl-2.0", "licensed under [the terms of] [version 2 of] the gnu general public license [gpl] version 2 [0]"),
    ("gpl-3.0", "licensed under [the terms of] [version 3 of] the gnu general public license [gpl] version 3 [0]"),
    ("gpl-or-later", _FREE + _TERMS + "gnu" + _FSF + _LATER + _HOPE),
    ("gpl-2.0", _FREE + _TERMS + "gnu (general public license version 2 as published by the free software foundation|"
                                 "general public license as published by the free software foundation version 2 [of the license])" + _HOPE),
    ("gpl-3.0", _FREE + _TERMS + "gnu (general public license version 3 as published by the free software foundation|"
                                 "general public license as published by the free software foundation version 3 [of the license])" + _HOPE),
    ("lgpl-or-later", _FREE + _TERMS + "gnu (lesser|library)" + _FSF + _LATER + _HOPE),
    ("agpl-or-later", _FREE + _TERMS + "gnu affero" + _FSF + _LATER + _HOPE),
    ("gpl-2.0", "gnu general public license version 2 june 1991 copyright {20} " + _VERBATIM),
    ("gpl-3.0", "gnu general public license version 3 29 june 2007 copyright {20} " + _VERBATIM),
    ("lgpl-2.1", "gnu lesser general public license version 2 1 february 1999 copyright {20} " + _VERBATIM),
    ("lgpl-3.0", "gnu lesser general public license version 3 29 june 2007 copyright {20} " + _VERBATIM),
    ("agpl-3.0", "gnu affero general public license version 3 19 november 2007 copyright {20} " + _VERBATIM),
    ("apache-2.0", "apache license version 2 0 january 2004 {6} terms and conditions for use reproduction and distribution 1 definitions"),
    ("mpl-2.0", "mozilla public license version 2 0 {2} 1 definitions"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed "
                "with this file you can obtain one at (http|https) [www] mozilla org mpl 2 0"),
    ("cc0-1.0", "to the extent possible under law {16} (has|have) (waived|dedicated) all copyright and related or neighboring rights to {16}"),
    ("cc0-1.0", "(released|licensed|distributed|available|published) under [the terms of] [a|the] [creative commons] (cc0|zero) 1 0 [universal] [license]"),
    ("cc-by-nc-nd-4.0", "licensed under [a|the] [creative commons] (cc by nc nd|attribution noncommercial noderivatives) 4 0 [international] [license]"),
    ("cc-by-nc-sa-4.0", "licensed under [a|the] [creative commons] (cc by nc sa|attribution noncommercial sharealike) 4 0 [international] [license]"),
    ("cc-by-nd-4.0", "licensed under [a|the] [creative commons] (cc by nd|attribution noderivatives) 4 0 [international] [license]"),
    ("bsd", "(the|a|an) bsd [2 clause|3 clause|4 clause|two clause|three clause] [simplified|new|modified|revised|original] license"),
    ("bsd", "bsd (2 clause|3 clause|4 clause) [simplified|new|modified|revised|original] license"),
    ("zlib", f"this software is provided {_AS_IS} without any express or implied warranty in no event will {{8}} be held liable for any damages "
             "arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial "
             "applications and to alter it and redistribute it freely subject to the following restrictions [1] the origin of this software must "
             "not be misrepresented you must not claim that you wrote the original software if you use this software in a product an "
             "(acknowledgment|acknowledgement) in the product documentation would be appreciated but is not required [2] altered source versions "
             "must be plainly marked as such and must not be misrepresented as being the original software [3] this notice may not be removed or "
             "altered from any source distribution"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell "
                  "or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial "
                  "and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all "
                  "copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to "
                  "the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all "
                  f"present and future rights to this software under copyright law the software is provided {_AS_IS} without warranty of any kind "
                  "express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and "
                  "noninfringement in no event shall the authors" + _MIT_END + " [for more information please refer to {4}]"),
    ("cc-by-4.0", "licensed under [a|the] [creative commons] (cc by|attribution) 4 0 [international] [license]"),
    ("cc-by-sa-4.0", "licensed under [a|the] [creative commons] (cc by sa|attribution sharealike) 4 0 [international] [license]"),
    ("cc-by-nc-4.0", "licensed under [a|the] [creative commons] (cc by nc|attribution noncommercial) 4 0 [international] [license]"),
    ("bsd", f"{_HOLDER}redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met [1|a] redistributions of source code must retain the above copyright notice this list of "
            "conditions and the following disclaimer [2|b] redistributions in binary form must reproduce the above copyright notice this "
            "list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
            "[[3|c] all advertising materials mentioning features or use of this software must display the following "
            "(acknowledgement|acknowledgment) this product includes software developed by {16}] "
            "[[3|4|c|d] (neither the (name|names) of {16} nor the names of (its|his|her|their|any) contributors may|"
            "the (name|names) of {16} may not) be used to endorse or promote products derived from this software without specific prior "
            f"written permission] this software is provided by {{16}} {_AS_IS} and any express or implied warranties including but not "
            "limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall "
            "{16} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to "
            "procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any "
            "theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out "
            "of the use of this software even if advised of the possibility of such damage"),
    ("isc", f"{_HOLDER}permission to use copy modify and [or] distribute this software for any purpose with or without fee is hereby "
            "granted provided that the above copyright notice and this permission notice appear in all copies the software is provided "
            f"{_AS_IS} and {{8}} (disclaims|disclaim) all warranties with regard to this software including all implied warranties of "
            "merchantability and fitness in no event shall {8} be liable for any special direct indirect or consequential damages or any "
            "damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other "
            "tortious action arising out of or in connection with the use or performance of this software"),
    ("spdx", "spdx license identifier {1}"),
    *spdx_templates(),
)

# One byte to one byte: A-Z lower-cased, ASCII other than letters and digits to
# a blank, everything above ASCII kept - so a split gives the words.
WORD_BYTES = bytes(b if b >= 128 or chr(b).isalnum() and b < 128 else 32 for b in range(256)).lower()

SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double, spans array<struct<label:string,start:long,end:long>>")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


class Automaton:
    """Words in, accepted ends out.  ``next[s]`` maps a word to states, ``any[s]``
    holds the state that any word leads to, ``free[s]`` states reached without one."""

    def __init__(self, label: str, markup: str):
        self.label = label
        self.next: list[dict[bytes, int]] = []
        self.any: list[int | None] = []
        self.free: list[set[int]] = []
        tokens = re.findall(r"[\[\]()|]|\{\d+\}|[^\s\[\]()|{}]+", markup.lower())
        self.required = self._required(tokens)
        start = self._state()
        end, rest = self._sequence(start, tokens)
        if rest:
            raise ValueError(f"unbalanced mark-up: {markup}")
        self.end = end
        closures = [self._reach(s) for s in range(len(self.next))]
        self.start = closures[start]
        self.closure = closures
        if end in self.start:
            raise ValueError(f"a template needs mandatory words: {markup}")
        self.first = {w for s in self.start for w in self.next[s]}
        if any(self.any[s] is not None for s in self.start):
            raise ValueError(f"a template begins with a word: {markup}")

    def _state(self) -> int:
        self.next.append({})
        self.any.append(None)
        self.free.append(set())
        return len(self.next) - 1

    @staticmethod
    def _required(tokens: list[str]) -> frozenset[bytes]:
        depth, out = 0, set()
        for t in tokens:
            depth += (t in ("[", "(")) - (t in ("]", ")"))
            if not depth and t not in ("[", "(", "]", ")", "|") and t[0] != "{":
                out.add(t.encode())
        return frozenset(out)

    def _sequence(self, at: int, tokens: list[str]) -> tuple[int, list[str]]:
        while tokens and tokens[0] not in ("]", ")", "|"):
            t, tokens = tokens[0], tokens[1:]
            if t in ("[", "("):
                close, out = ("]" if t == "[" else ")"), self._state()
                while True:
                    branch = self._state()
                    self.free[at].add(branch)
                    done, tokens = self._sequence(branch, tokens)
                    self.free[done].add(out)
                    mark, tokens = tokens[0], tokens[1:]
                    if mark == close:
                        break
                if t == "[":
                    self.free[at].add(out)
                at = out
            elif t[0] == "{":
                for _ in range(int(t[1:-1])):
                    to = self._state()
                    self.any[at] = to
                    self.free[at].add(to)
                    at = to
            else:
                to = self._state()
                self.next[at][t.encode()] = to
                at = to
        return at, tokens

    def _reach(self, state: int) -> frozenset[int]:
        seen, todo = {state}, [state]
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def match(self, words: list[bytes], at: int) -> int:
        """End of the longest accepted run of words from ``at``, or -1."""
        states, end = self.start, -1
        for n in range(at, len(words)):
            reached: set[int] = set()
            for s in states:
                to = self.next[s].get(words[n])
                if to is not None:
                    reached |= self.closure[to]
                if self.any[s] is not None:
                    reached |= self.closure[self.any[s]]
            if not reached:
                break
            states = reached
            if self.end in states:
                end = n + 1
        return end


def compile_templates(templates=TEMPLATES) -> list[Automaton]:
    return [Automaton(label, markup) for label, markup in templates]


def _places(words: list[bytes], wanted) -> Iterator[int]:
    for word in wanted:
        at = -1
        try:
            while True:
                at = words.index(word, at + 1)
                yield at
        except ValueError:
            pass


def scan_words(words: list[bytes], automata: list[Automaton], phrases) -> tuple:
    """(base places as (start, words, label), accepted spans as (label, start, end))."""
    there = set(words)
    base = [(at, len(p), label) for p, label in phrases if there.issuperset(p)
            for at in _places(words, p[:1]) if words[at:at + len(p)] == p]
    spans = []
    for a in automata:
        if not there.issuperset(a.required):
            continue
        behind = 0
        for at in sorted(_places(words, a.first)):
            if at >= behind and (end := a.match(words, at)) >= 0:
                spans.append((a.label, at, end))
                behind = end
    # of a licence and one that goes on from its wording, the longer holds
    longest: dict[int, int] = {}
    for _, at, end in spans:
        longest[at] = max(end, longest.get(at, 0))
    return base, sorted((s for s in spans if s[2] == longest[s[1]]), key=lambda s: (s[1], s[2], s[0]))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES,
                  phrases=BASE_PHRASES) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score, spans``.

    Words are runs of ASCII letters and digits (A-Z lower-cased) and of
    characters above ASCII, over the whole text.  ``spans`` are the places the
    templates accept (leftmost, longest, not overlapping per template; of those
    that begin at one word the longest);
    ``labels`` are theirs and the base phrases'; ``score`` is the share of the
    text's words that lie in a span or a base phrase.  NULL and empty texts
    have no words, no labels (empty string) and score 0.  Ids may be NULL or
    repeat.  Empty input gives no rows; other columns are ignored.
    """
    plain = [(p.encode().split(), label) for p, label in phrases]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automata = compile_templates(templates)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                words = words_of(text if isinstance(text, str) else None)
                base, spans = scan_words(words, automata, plain)
                covered = {i for at, n, _ in base for i in range(at, at + n)}
                covered.update(i for _, lo, hi in spans for i in range(lo, hi))
                own = {label for _, _, label in base}
                out.append((doc_id, len(words), len(base), min((b[0] for b in base), default=None),
                            max((b[0] for b in base), default=None), ",".join(sorted(own)),
                            ",".join(sorted(own | {s[0] for s in spans})), len(covered) / len(words) if words else 0.0,
                            [{"label": a, "start": b, "end": c} for a, b, c in spans]))
            frame = pd.DataFrame(out, columns=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
                                               "labels", "score", "spans"])
            for c in ("doc_id", "first_word", "last_word"):
                frame[c] = frame[c].astype("Int64")
            yield frame

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInPandas(scan, SCHEMA))
