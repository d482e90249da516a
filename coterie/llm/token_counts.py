"""Greedy longest-match word-piece counts by a linear automaton, without building pieces.

A trie over the vocabulary holds pieces that open or continue a word and, ending in the end mark, pieces
that close one.  Each node has a failure link, the node reached after the longest prefixes of its text
have been split off, and the number of pieces popped on the way, both worked out once for the whole
trie.  A word is then read once, byte by byte: follow an edge if there is one, else take the failure
link and add its pops; every step either reads a byte or shortens what is pending, so the work is
linear in the word, and longest-match counts come out exactly as greedy matching would give them.

The last piece of a word is one that closes it.  So a piece that does not close is taken only where
bytes follow it, and what is pending at the word's end (no longer than a piece) is split by the same
rule, worked out once per node: the piece that closes all of it, else the longest one that leaves some.

Pieces are those of the given vocabulary file: an entry with the end-of-word suffix closes a word,
other entries open or continue one.  Every single byte is a piece, so no word fails.  Words are runs
of other than ASCII white space, lower-cased (A-Z); a worker remembers the counts of words seen.

Edge cases: a null or blank text has no tokens; a null id is kept; repeated rows stay; texts of any
length are read whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from coterie.llm.common import small_batches

VOCABULARY = "word_bpe_49k.json"
REMEMBERED = 400_000
_END = 256


def load_vocabulary(name: str = VOCABULARY) -> set[bytes | tuple]:
    """Pieces as byte strings; those that close a word end in the mark 256, so each is a tuple of numbers."""
    if "/" not in name:
        import public_tokenizers

        name = str(public_tokenizers.path(name))
    with open(name, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    # The file writes bytes as letters: printable Latin-1 as itself, the rest from U+0100 on, in order.
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in kept)}
    out = set()
    for piece in vocabulary:
        closes = piece.endswith("</w>")
        text = piece[:-4] if closes else piece
        if text and all(c in byte for c in text):
            out.add((*(byte[c] for c in text), *([_END] if closes else [])))
    return out


class LongestMatch:
    """The automaton.  ``edges[node]`` maps a symbol to a node; ``fail`` and ``pops`` are lists by node."""

    def __init__(self, pieces):
        pieces = set(pieces) | {(b,) for b in range(256)} | {(b, _END) for b in range(256)}
        self.edges: list[dict[int, int]] = [{}]
        accepts = [False]
        for p in pieces:
            node = 0
            for s in p:
                nxt = self.edges[node].get(s)
                if nxt is None:
                    nxt = self.edges[node][s] = len(self.edges)
                    self.edges.append({})
                    accepts.append(False)
                node = nxt
            accepts[node] = True
        self.fail = [-1] * len(self.edges)
        self.pops = [0] * len(self.edges)
        level = [0]
        while level:  # breadth first: links of shorter texts are known
            after = []
            for u in level:
                for s, v in self.edges[u].items():
                    if accepts[v]:
                        self.fail[v], self.pops[v] = 0, 1
                    else:
                        z, n = self.fail[u], self.pops[u]
                        while z >= 0 and s not in self.edges[z]:
                            n += self.pops[z]
                            z = self.fail[z]
                        if z >= 0:
                            self.fail[v], self.pops[v] = self.edges[z][s], n
                    after.append(v)
            level = after
        self.texts: list[tuple] = [()] * len(self.edges)
        self.accepts, self.last = accepts, {}
        for u, edges in enumerate(self.edges):  # nodes are numbered after their parents
            for s, v in edges.items():
                self.texts[v] = (*self.texts[u], s)
        self.seen: dict[bytes, int] = {}

    def closing(self, node: int) -> int:
        """Number of pieces of the text of a node where a word ends."""
        if node not in self.last:
            if _END in self.edges[node]:
                self.last[node] = 1
            else:
                text, u, k = self.texts[node], 0, 0
                for i, s in enumerate(text[:-1]):
                    u = self.edges[u][s]
                    if self.accepts[u]:
                        k = i + 1
                rest, pops = self.read(text[k:])
                self.last[node] = 1 + pops + self.closing(rest)
        return self.last[node]

    def read(self, symbols) -> tuple[int, int]:
        """(node of what is pending, pieces popped) after these bytes."""
        edges, fail, pops = self.edges, self.fail, self.pops
        node = total = 0
        for s in symbols:
            while (nxt := edges[node].get(s)) is None:
                total += pops[node]
                node = fail[node]
            node = nxt
        return node, total

    def count(self, word: bytes) -> int:
        """Number of pieces of one word."""
        node, total = self.read(word)
        return total + self.closing(node) if node else 0

    def text(self, data: bytes) -> tuple[int, int]:
        """(words, tokens) of a text."""
        words, total, seen = data.lower().split(), 0, self.seen
        for w in words:
            n = seen.get(w)
            if n is None:
                n = self.count(w)
                if len(seen) < REMEMBERED:
                    seen[w] = n
            total += n
        return len(words), total


_AUTOMATA: dict[str, LongestMatch] = {}


def automaton(name: str = VOCABULARY) -> LongestMatch:
    if name not in _AUTOMATA:
        _AUTOMATA[name] = LongestMatch(load_vocabulary(name))
    return _AUTOMATA[name]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``id_col, n_words, n_tokens`` of every document."""
    import pyarrow as pa

    small_batches(docs.sparkSession)

    def run(batches):
        counter = automaton(vocabulary)
        for b in batches:
            got = [counter.text(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())], names=[id_col, "n_words", "n_tokens"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, n_tokens bigint")


QUERY = "op1_token_counts"


def query(spark, sf_dir: str) -> DataFrame:
    from coterie.llm.common import table

    return token_counts(table(spark, sf_dir, "documents"))
