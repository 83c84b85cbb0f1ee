"""License scans: Aho-Corasick finds identifier tags and notice phrases; a shunting-yard parser evaluates license expressions.

A text is lower-cased (A-Z) and cut into words of ASCII digits, letters and all non-ASCII characters. The words, joined by
single spaces, go once through an automaton of all phrases, each with a space on either side, so a phrase is found
wherever its words stand consecutively, whatever is between them, and overlapping places count each.

After an `SPDX-License-Identifier` tag the rest of the line is an expression of identifiers, AND, OR, WITH, `+`
and brackets. The longest whole expression at its start counts, and prose after it does not. An identifier is one of the vocabulary, a
`LicenseRef-` name, a name with a version (NAMED), or any other token that looks like one (LIKE): unknown ones are labels too. The parser turns the expression into postfix order and evaluates
it twice: which identifiers it names, and whether one can comply with it by permissive licenses alone (OR: either side, AND: both, WITH: the license before it), where
unknown identifiers and exceptions leave that open. If what follows the whole expression isn't prose (an operator without a whole operand, an open bracket, one more identifier), a condition
may be lost: its identifiers are labels, and the answer is never yes. All tags of a text are read, once each; `permissive` is that
of all expressions together (each must hold): true, false, or null for open and for no expression at all.

Notice phrases and licenses may come as tables (Vocabulary.of), MAX_TERMS rows of each at most.

Null and empty texts have no words, no places, no labels and score 0. Texts are scanned whole, in one pass over their words and one over their
tags. Repeated rows and null ids are rows like others. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base phrases and labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Phrases of our own: label and how sure a place makes us.
NOTICES = {
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "boost software license": ("boost", 0.9),
    "bsd license": ("bsd", 0.8),
    "bsd 2 clause": ("bsd", 0.8),
    "bsd 3 clause": ("bsd", 0.8),
    "isc license": ("isc", 0.8),
    "the unlicense": ("unlicense", 0.6),
    "creative commons": ("cc", 0.5),
    "cc by nc": ("cc-by-nc", 0.8),
    "cc by nd": ("cc-by-nd", 0.8),
    "cc by sa": ("cc-by-sa", 0.8),
    "cc0 1 0": ("cc0", 0.8),
    "gnu general public license version 2": ("gpl-2", 0.9),
    "gnu general public license version 3": ("gpl-3", 0.9),
    "apache license version 2 0": ("apache-2.0", 0.9),
    "all rights reserved": ("all-rights-reserved", 0.3),
}
BASE_SURE, TAG_SURE = 0.8, 0.95
TAG = "spdx license identifier"
PERMISSIVE = frozenset({"mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "0bsd", "zlib", "unlicense", "cc0-1.0", "cc-by-4.0", "boost-1.0", "bsl-1.0"})
#: License identifiers without a version in their names.
KNOWN = PERMISSIVE | frozenset(
    "aal abstyles adsl afmparse aladdin apafml bahyph barr beerware blessing borceux cnri-python cnri-jython curl docbook-xml diffmark dotseqn dsdp dvipdfm egenix entessa eupl fair fsfap fsful fsfullr "
    "ftl giftware gl2ps glulxe gpl lgpl agpl mpl epl hpnd htmltidy ibm-pibs icu ijg imagemagick imatix info-zip intel intel-acpi jasper-2.0 jpnic json kastrup latex2e leptonica libpng libtiff "
    "linux-openib mit-0 mit-advertising mit-cmu mit-modern-variant miros motosoto mpich2 mtll multics mup nasa-1.3 naumen ncsa net-snmp netcdf newsletr ngpl nist-pd nlpl noweb nrl ntp o-uda-1.0 oml "
    "openssl php-3.0 plexus postgresql psfrag psutils python-2.0 qhull rdisc ruby saxpath scea sendmail sissl sleepycat smlnj snia ssh-openssh ssh-short swl tcl tcp-wrappers tmate unicode-tou "
    "upl-1.0 vim vostrom w3c wsuipa wtfpl x11 xerox xinetd xnet xpp xskat zed zlib-acknowledgement bsd-3-clause-clear bsd-3-clause-lbnl bsd-source-code bzip2-1.0.6 artistic-1.0-perl "
    "classpath-exception-2.0 gcc-exception-3.1 llvm-exception autoconf-exception-3.0 bison-exception-2.2 linux-syscall-note font-exception-2.0 openvpn-openssl-exception".split()
)
#: Identifiers by their shape: a reference of one's own, or a name that ends in a version, and perhaps what follows it.
NAMED = re.compile(r"(documentref-[a-z0-9.\-]+:)?licenseref-[a-z0-9.\-]+|[a-z][a-z0-9.\-]*-v?[0-9]+(\.[0-9]+)*[a-z]?(-only|-or-later|-clause|-clause-patent|-no-copyleft-exception)?|[a-z0-9\-]+-exception(-[0-9.]+)?")
#: What else looks like an identifier: a word with a hyphen, an underscore or a digit in it.
LIKE = re.compile(r"(?=.*[-_0-9])[a-z][a-z0-9.\-_]*")
#: Most rows of a table of phrases or licenses.
MAX_TERMS = 100_000

_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_TAG_LINE = re.compile(r"spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)", re.IGNORECASE)
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9](?:[A-Za-z0-9.\-:_/]*[A-Za-z0-9])?\+?")
_BINDS = {"or": 1, "and": 2, "with": 3}


def to_postfix(expression: str) -> list[str]:
    """Shunting-yard; raises ValueError on a broken expression. Operators are returned as or, and, with; identifiers in lower case."""
    out: list[str] = []
    waiting: list[str] = []
    operand_next = True
    for token in (t.lower() for t in _TOKEN.findall(expression)):
        if token == "(":
            if not operand_next:
                raise ValueError(expression)
            waiting.append(token)
        elif token == ")":
            if operand_next:
                raise ValueError(expression)
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                raise ValueError(expression)
            waiting.pop()
        elif token in _BINDS:
            if operand_next:
                raise ValueError(expression)
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[token]:
                out.append(waiting.pop())
            waiting.append(token)
            operand_next = True
        else:
            if not operand_next:
                raise ValueError(expression)
            out.append(token)
            operand_next = False
    if operand_next or "(" in waiting:
        raise ValueError(expression)
    return out + waiting[::-1]


@dataclass(frozen=True)
class Vocabulary:
    #: Phrase (lower-case words, single spaces) -> label and how sure a place makes us.
    notices: dict[str, tuple[str, float]] = field(default_factory=lambda: NOTICES)
    known: frozenset[str] = KNOWN
    permissive: frozenset[str] = PERMISSIVE

    @staticmethod
    def of(notices: DataFrame | None = None, licenses: DataFrame | None = None) -> Vocabulary:
        """notices: phrase, label, sure. licenses: identifier, permissive. Either replaces the built-in ones; raises beyond MAX_TERMS rows."""

        def rows(df: DataFrame) -> list:
            found = df.limit(MAX_TERMS + 1).collect()
            if len(found) > MAX_TERMS:
                raise ValueError(f"more than {MAX_TERMS} terms")
            return found

        own = Vocabulary()
        if notices is not None:
            own = replace(own, notices={" ".join(r["phrase"].encode().translate(_TABLE).decode("utf-8").split()): (r["label"], float(r["sure"])) for r in rows(notices)})
        if licenses is not None:
            found = rows(licenses)
            own = replace(own, known=frozenset(r["identifier"].lower() for r in found), permissive=frozenset(r["identifier"].lower() for r in found if r["permissive"]))
        return own


BUILT_IN = Vocabulary()


def is_identifier(token: str, terms: Vocabulary = BUILT_IN) -> bool:
    name = token.lower().rstrip("+")
    return name in terms.known or NAMED.fullmatch(name) is not None or LIKE.fullmatch(name) is not None


def complies(name: str, terms: Vocabulary) -> bool | None:
    """Whether a license is permissive; None if nobody knows it."""
    return True if name in terms.permissive else False if name in terms.known or NAMED.fullmatch(name) else None


def both(a: bool | None, b: bool | None) -> bool | None:
    return False if a is False or b is False else None if a is None or b is None else True


def either(a: bool | None, b: bool | None) -> bool | None:
    return True if a or b else None if a is None or b is None else False


def evaluate(postfix: list[str], terms: Vocabulary = BUILT_IN) -> tuple[set[str], bool | None]:
    """The licenses named, and whether permissive ones suffice."""
    stack: list[tuple[set[str], bool | None]] = []
    for token in postfix:
        if token not in _BINDS:
            name = token.rstrip("+")
            stack.append(({name}, complies(name, terms)))
            continue
        (b, b_ok), (a, a_ok) = stack.pop(), stack.pop()
        if token == "with":
            # an exception that nobody knows may as well restrict, so it is shown and leaves open what was a yes
            if any(complies(x, terms) is None for x in b):
                a, a_ok = a | b, both(a_ok, None)
        else:
            # the smaller set joins the larger one, so long expressions stay nearly linear
            a, b = (a, b) if len(a) >= len(b) else (b, a)
            a |= b
            a_ok = both(a_ok, b_ok) if token == "and" else either(a_ok, b_ok)
        stack.append((a, a_ok))
    return stack[0]


def whole_prefix(tokens: list[str], terms: Vocabulary = BUILT_IN) -> int:
    """How many tokens the longest whole expression at the start has, in one pass: up to the last place with an operand just read and no open bracket."""
    depth, operand_next, whole = 0, True, 0
    for n, token in enumerate((t.lower() for t in tokens), 1):
        operand = token not in _BINDS and token not in "()"
        if operand_next != (token == "(" or operand) or operand and not is_identifier(token, terms):
            break
        if token == "(":
            depth += 1
        elif token == ")":
            depth -= 1
            if depth < 0:
                break
        else:
            operand_next = token in _BINDS
        if not operand_next and not depth:
            whole = n
    return whole


def read_expression(text: str, terms: Vocabulary = BUILT_IN) -> tuple[set[str], bool | None]:
    """The whole expression at the start, of any length, and what a tail that is no prose takes from it: the tail's identifiers are named too, and a yes is left open."""
    tokens = _TOKEN.findall(text)
    n = whole_prefix(tokens, terms)
    names, holds = evaluate(to_postfix(" ".join(tokens[:n])), terms) if n else (set(), None)
    tail = [t for t in itertools.takewhile(lambda t: t in "()" or t.lower() in _BINDS or is_identifier(t, terms), tokens[n:])]
    # a conjunction in small letters before an ordinary word is prose
    if tail and not (len(tail) == 1 and tail[0] in ("and", "or", "with") and len(tokens) > n + 1):
        names |= {t.lower().rstrip("+") for t in tail if t not in "()" and t.lower() not in _BINDS}
        holds = both(holds, None) if n else None
    return names, holds


def automaton(terms: Vocabulary = BUILT_IN) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {*BASE, *terms.notices, TAG}:
        # the automaton reads bytes, one letter each
        key = phrase.encode("utf-8", "surrogatepass").decode("latin-1")
        found.add_word(f" {key} ", (phrase, len(key) + 2))
    found.make_automaton()
    return found


def scan(text: str, phrases: ahocorasick.Automaton, terms: Vocabulary = BUILT_IN) -> dict:
    words = text.encode("utf-8", "surrogatepass").translate(_TABLE).split()
    line = f" {b' '.join(words).decode('latin-1')} "
    starts, base, labels, missing, verdicts, tagged = [], set(), set(), 1.0, [], False
    for end, (phrase, size) in phrases.iter(line):
        if phrase in BASE:
            starts.append(end + 1 - size)
            base.add(BASE[phrase])
            missing *= 1 - BASE_SURE
        elif phrase in terms.notices:
            label, sure = terms.notices[phrase]
            labels.add(label)
            missing *= 1 - sure
        else:
            tagged = True
    for rest in _TAG_LINE.findall(text) if tagged else ():
        names, holds = read_expression(rest, terms)
        if names:
            labels |= names
            missing *= 1 - TAG_SURE
            verdicts.append(holds)
    first = line.count(" ", 0, min(starts)) if starts else None
    last = line.count(" ", 0, max(starts)) if starts else None
    return {
        "n_words": len(words), "n_base": len(starts), "first_word": first, "last_word": last, "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(base | labels)), "score": 1 - missing, "permissive": functools.reduce(both, verdicts) if verdicts else None,
    }


SCHEMA = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("permissive", pa.bool_())])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms: Vocabulary = BUILT_IN) -> DataFrame:
    """A row for each row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, permissive (null where that is open, and without an expression)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = automaton(terms)
        for batch in batches:
            rows = [scan(t or "", phrases, terms) for t in batch.column(1).to_pylist()]
            found = pa.RecordBatch.from_pylist(rows, schema=SCHEMA)
            yield pa.RecordBatch.from_arrays([batch.column(0), *found.columns], names=[id_col, *SCHEMA.names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias("__text")).mapInArrow(
        run, f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permissive boolean"
    )
