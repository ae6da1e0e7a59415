"""License scan: templates with optional and replaceable regions as one token automaton.

A template is plain wording with ``[[...]]`` around words that may be missing and ``{{n}}`` for
up to n words of any kind; regions nest. All templates, and the fixed phrases whose places are
counted, compile into one nondeterministic automaton over words. A text runs through it once:
the set of states that some run of its words may be in is a node, and nodes and the words that
lead from one to the next are worked out when first met and remembered, so each word costs one
look-up, however many templates there are. A text has a template's label where the automaton
accepts a run of its words, that is, where all mandatory wording stands in order without
anything else between.

Words are runs of ASCII letters and digits and anything beyond ASCII, with A-Z lower-cased.
Defined cases: a null or empty text has no words and no places; all places count, also in very
long texts and where they overlap; equal rows give equal rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from vidra.llm.kernels import ALNUM_WORDS, buffers
from vidra.llm.license_texts import TEMPLATES
from vidra.llm.shared import ship, text_only

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

_TABLE = bytes(int(ALNUM_WORDS[1][b]) if ALNUM_WORDS[0][b] else 0x20 for b in range(256))
#: Nodes that are remembered; beyond it they are worked out anew.
MAX_NODES = 1 << 16


class Node:
    """A set of states: what words lead on to, and what is accepted on reaching it."""

    __slots__ = ("states", "on", "other", "labels", "phrases")

    def __init__(self, states: frozenset[int]):
        self.states, self.on, self.other = states, {}, None
        self.labels: tuple[str, ...] = ()
        self.phrases: tuple[tuple[int, str], ...] = ()


class Automaton:
    """Templates and phrases. States are numbers; from each, a word or any word leads on, or nothing is needed to go on."""

    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]]):
        self.by_word: list[dict[bytes, list[int]]] = []
        self.by_any: list[list[int]] = []
        self.free: list[list[int]] = []
        self.label_of: dict[int, str] = {}
        self.phrase_of: dict[int, tuple[int, str]] = {}
        #: A text without any of these words has neither phrase nor template.
        self.anchors: set[bytes] = set()
        starts = []
        for phrase, label in phrases.items():
            start, end, words = self._compile(phrase)
            starts.append(start)
            self.phrase_of[end] = (len(words), label)
        for label, template in templates:
            start, end, words = self._compile(template)
            if not words:
                raise ValueError(f"a template of {label} has no mandatory word")
            starts.append(start)
            self.label_of[end] = label
        self.vocabulary = {w for d in self.by_word for w in d}
        self.starts = frozenset(self._closed(set(starts)))
        self.nodes: dict[frozenset[int], Node] = {}
        self.first = self._node(self.starts)

    def _state(self) -> int:
        self.by_word.append({})
        self.by_any.append([])
        self.free.append([])
        return len(self.free) - 1

    def _compile(self, template: str) -> tuple[int, int, list[bytes]]:
        """First and last state and the mandatory words; the longest of these becomes an anchor."""
        start = at = self._state()
        open_: list[int] = []
        mandatory: list[bytes] = []
        for part in re.findall(rb"\[\[|\]\]|\{\{[0-9]+\}\}|[a-z0-9\x80-\xff]+", template.encode().lower()):
            if part == b"[[":
                # A state of its own, so that what ends before is not entered again.
                self.free[at].append(nxt := self._state())
                at = nxt
                open_.append(at)
            elif part == b"]]":
                nxt = self._state()
                self.free[at].append(nxt)
                self.free[open_.pop()].append(nxt)
                at = nxt
            elif part[:2] == b"{{":
                hops = [at]
                for _ in range(int(part[2:-2])):
                    nxt = self._state()
                    self.by_any[at].append(nxt)
                    at = nxt
                    hops.append(at)
                for h in hops[:-1]:
                    self.free[h].append(at)
            else:
                nxt = self._state()
                self.by_word[at].setdefault(part, []).append(nxt)
                if not open_:
                    mandatory.append(part)
                at = nxt
        if mandatory:
            self.anchors.add(max(mandatory, key=len))
        return start, at, mandatory

    def _closed(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def _node(self, states: frozenset[int]) -> Node:
        found = self.nodes.get(states)
        if found is None:
            if len(self.nodes) >= MAX_NODES:
                self.nodes.clear()
            found = self.nodes[states] = Node(states)
            found.labels = tuple(self.label_of[s] for s in states if s in self.label_of)
            found.phrases = tuple(self.phrase_of[s] for s in states if s in self.phrase_of)
        return found

    def _next(self, node: Node, word: bytes) -> Node:
        """The node that a word leads to; a run may begin at every word."""
        known = word in self.vocabulary
        if not known and node.other is not None:
            return node.other
        on = {t for s in node.states for t in (*self.by_word[s].get(word, ()), *self.by_any[s])}
        found = self._node(frozenset(self._closed(on)) | self.starts)
        if known:
            node.on[word] = found
        else:
            node.other = found
        return found

    def run(self, words: list[bytes]) -> tuple[set[str], list[tuple[int, str]]]:
        """The labels of the templates that accept some run of the words; where phrases start, with their labels."""
        labels: set[str] = set()
        places: list[tuple[int, str]] = []
        node = self.first
        for i, word in enumerate(words):
            node = node.on.get(word) or self._next(node, word)
            if node.labels:
                labels.update(node.labels)
            for n, label in node.phrases:
                places.append((i - n + 1, label))
        return labels, places


class Scanner:
    """Phrases and templates, compiled."""

    def __init__(self, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None):
        self.automaton = Automaton(PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates)

    def scan(self, text: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
        flat = text.translate(_TABLE)
        words = flat.split()
        if not any(a in flat for a in self.automaton.anchors):
            return len(words), 0, None, None, "", "", 0.0
        labels, places = self.automaton.run(words)
        base, at = {label for _, label in places}, [i for i, _ in places]
        score = 1.0 if labels else 0.5 if base else 0.0
        return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score


def scan(spark: SparkSession, docs: DataFrame, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row a document: words, phrase places and the labels of phrases and templates."""
    ship(spark)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        for batch in batches:
            data, off = buffers(batch.column(1))
            raw, at = memoryview(data), off.tolist()
            rows = [scanner.scan(bytes(raw[a:b])) for a, b in zip(at, at[1:])]
            columns = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", *names])

    return text_only(docs).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
