"""BPE encoding and decoding by a tokenization automaton.

The merges are compiled, in their order, into a deterministic automaton whose arcs are labelled with tokens: it reads
exactly the correct tokenizations. It starts as one state with a loop for each base symbol. The gadget of merge
number k, of u and v, gives the state entered by u a copy without the arc v (the old state stays for those that share
it), and adds the arc uv beside every arc u that v could follow, leading where v led. States are kept as differences
(what was removed, when, and from which state), since each has tens of thousands of arcs; arc(q, t) reads the table.

Encoding a word is a walk over the transitions: positions of the word are visited left to right; from the state at a
position every token that matches there (by a trie over the arcs' labels) and has an arc leads to a later position.
Each prefix has one correct tokenization, so each position gets one state. Decoding emits the labels of the arcs.

Whole texts are cut at spaces and line feeds, which no token of the supported file crosses; each distinct piece is
normalised, split and walked once, within a bounded cache.

Defined results: null text is the empty text: no token, and the hash of the empty string. Special tokens standing in
a text become their ids, as the tokenizers library does. Repeated rows and null ids are encoded each by itself; extra
columns are ignored; texts are encoded whole.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re

import regex
from pyspark.sql import DataFrame

from tideflow.llm.common import Memo, map_rows, struct


def _byte_chars() -> dict[int, int]:
    """Byte-level files write printable bytes as themselves and the others, in order, as the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: 256 + k for k, b in enumerate(others)}


_BYTE_CHARS = _byte_chars()


class Row(Memo):
    """A state's row of the transition table: token -> whether it has the arc. Filled as it is asked."""

    def __init__(self, arc) -> None:
        super().__init__(arc, 8192)


class Node(dict):
    """A state of the matcher: symbol -> the next one. Steps that go by way of `fail` are added when first taken."""

    __slots__ = ("above", "depth", "end", "fail", "symbol")

    def __init__(self, above: Node | None, symbol: str) -> None:
        super().__init__()
        self.above, self.symbol, self.end, self.fail = above, symbol, (), None
        self.depth = above.depth + 1 if above is not None else 0

    def __missing__(self, symbol: str) -> Node:
        to = self.fail[symbol] if self.fail is not None else self
        self[symbol] = to
        return to


class TokenAutomaton:
    """Compiled from token ids and ordered merges (pairs of token strings). State 0 is the start; state t + 1 is entered by token t.

    What a state lost in the copies made of it is `lost`, keyed by state and token, with the number of the merge. The
    state entered by a merged token is the one its right part led to when the merge was read, so it shares what that
    one had lost before.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = "") -> None:
        self.vocab, self.suffix = vocab, suffix
        size = max(vocab.values(), default=0) + 1
        self.lost: dict[int, int] = {}
        self.never: set[int] = set()
        self.shift = size.bit_length() + 1
        self.left, self.right, self.born = [-1] * size, [-1] * size, [0] * size
        for k, (u, v) in enumerate(merges):
            self._gadget(k, vocab[u], vocab[v], vocab[u + v])
        self._compile_matcher()
        self.start = Row(lambda token: True)
        self.rows: dict[int, Row] = Memo(lambda token: Row(lambda t: self._arc(token + 1, t)), size)

    def _symbols(self, token: str) -> list[str]:
        """Base symbols of a token: characters, the last one of a word with the suffix."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def _compile_matcher(self) -> None:
        """Transitions over base symbols: a node for each prefix of a token, which knows the tokens that end there, the longest first."""
        self.length = [0] * len(self.left)
        self.root = Node(None, "")
        made = [self.root]
        for token, i in self.vocab.items():
            symbols = self._symbols(token)
            if len(symbols) == 1 or self.left[i] >= 0:
                self.length[i], node = len(symbols), self.root
                for c in symbols:
                    if c not in node:
                        made.append(Node(node, c))
                        dict.__setitem__(node, c, made[-1])
                    node = dict.__getitem__(node, c)
                node.end = ((len(symbols), i),)
        self.known = set(self.root)
        own = [dict(n) for n in made]  # fail links follow the tokens' own prefixes, not transitions added later
        by_depth = sorted(zip(made, own), key=lambda x: x[0].depth)
        prefix = {id(n): d for n, d in by_depth}
        for node, _ in by_depth[1:]:
            if node.depth > 1:
                q = node.above.fail
                while q is not self.root and node.symbol not in prefix[id(q)]:
                    q = q.fail
                node.fail = prefix[id(q)].get(node.symbol, self.root)
            else:
                node.fail = self.root
            node.end = node.end + node.fail.end

    def _gadget(self, k: int, u: int, v: int, uv: int) -> None:
        """Copy the state entered by u without the arc v, and add the arc uv. Where that arc was gone already the merge can never happen, and there is no arc uv."""
        if u in self.never or v in self.never or not self._arc(u + 1, v):
            self.never.add(uv)
            return
        self.lost[(u + 1) << self.shift | v] = k
        self.left[uv], self.right[uv], self.born[uv] = u, v, k

    def _lost_at(self, state: int, token: int, before: float = float("inf")) -> float:
        """The first merge that removed the arc from the state or from one it was copied from, while that one was still shared."""
        first = float("inf")
        while state > 0:
            at = self.lost.get(state << self.shift | token)
            if at is not None and at < before:
                first = at
            before = self.born[state - 1]
            state = self.right[state - 1] + 1
        return first

    def _arc(self, state: int, token: int) -> bool:
        """Whether the state has the arc. The arc of a merged token was added beside its left part's, if that was there then."""
        if self._lost_at(state, token) != float("inf"):
            return False
        while (part := self.left[token]) >= 0:
            if self._lost_at(state, part) <= self.born[token]:
                return False
            token = part
        return True

    def walk(self, symbols: list[str]) -> list[int]:
        """Labels of the arcs that read the symbols, all of them base symbols. As each is a token, every prefix has its tokenization."""
        node, states, came, rows = self.root, [self.start], [], self.rows
        for c in symbols:
            node = node[c]
            for length, token in node.end:
                if states[-length][token]:
                    states.append(rows[token])
                    came.append(token)
                    break
        out, j, length = [], len(came), self.length
        while j:
            token = came[j - 1]
            out.append(token)
            j -= length[token]
        out.reverse()
        return out


class AutomatonTokenizer:
    """Reads a tokenizers JSON file of a BPE model. Normalising and splitting are the library's own; encoding and decoding are the automaton's."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or spec.get("decoder"):
            raise ValueError("only BPE files without a decoder and a subword prefix are supported")
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        self.normalize = library.normalizer.normalize_str if library.normalizer else str
        self.split = library.pre_tokenizer.pre_tokenize_str
        self.pattern = None
        parts = spec["pre_tokenizer"].get("pretokenizers", [])
        if [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in parts] == ["Split", "ByteLevel"] and parts[0]["behavior"] == "Removed" and parts[0]["invert"]:
            self.pattern = regex.compile(parts[0]["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) + ")") if self.special else None
        self.automaton = TokenAutomaton(model["vocab"], merges, self.suffix)
        self.ids = model["vocab"]
        self.labels = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.words, self.pieces = Memo(self._word, 400_000), Memo(self._piece, 600_000)
        gc.freeze()  # the tables are never garbage

    def word(self, word: str) -> list[int]:
        symbols = [*word[:-1], word[-1] + self.suffix]
        known = self.automaton.known
        if not known.issuperset(symbols):  # symbols outside the vocabulary are dropped, as there is no unknown token
            symbols = [c for c in symbols if c in known]
        return self.automaton.walk(symbols)

    def _word(self, word: str) -> tuple[int, str, str]:
        ids = self.word(word)
        return len(ids), " ".join(map(str, ids)), self.decode(ids)

    def _words(self, piece: str) -> list[str]:
        """Normalised and split. Printable Latin text takes a short way when the file's normalizer and pattern are those it was written for; the rest goes through the library."""
        if self.pattern is not None and piece.isprintable() and max(piece) < "\u0250":
            return [w.encode().decode("latin-1").translate(_BYTE_CHARS) for w in self.pattern.findall(piece.lower())]
        return [w for w, _ in self.split(self.normalize(piece))]

    def _piece(self, piece: str) -> tuple[int, str, str]:
        words = self.words
        got = [g for w in self._words(piece) if (g := words[w])[0]]
        return got[0] if len(got) == 1 else _joined(got)

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.labels[i] for i in ids)

    def encode_text(self, text: str | None) -> tuple[int, str, str]:
        """Number of tokens, their ids joined by spaces, and the decoded text."""
        text = text or ""
        if self.cut is not None and "<|" in text:
            parts = []
            for part in self.cut.split(text):
                parts += [(1, str(self.special[part]), part)] if part in self.special else [p for p in (self._plain(part),) if p[0]]
        else:
            return self._plain(text)
        return _joined(parts)

    def _plain(self, text: str) -> tuple[int, str, str]:
        pieces = self.pieces
        got = [g for p in text.replace("\n", " ").split(" ") if p and (g := pieces[p])[0]]
        return _joined(got)


def _joined(parts: list[tuple[int, str, str]]) -> tuple[int, str, str]:
    return sum([p[0] for p in parts]), " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts])


_LOADED: dict[str, AutomatonTokenizer] = {}


def load(path: str) -> AutomatonTokenizer:
    """One compiled automaton for each worker process."""
    if path not in _LOADED:
        _LOADED[path] = AutomatonTokenizer(path)
    return _LOADED[path]


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: the key, n_tokens, and the hashes of its ids and of its decoded text."""

    def make():
        tok = load(path)

        def fn(ids, texts):
            got = [tok.encode_text(t) for t in texts]
            digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
            return [ids, [g[0] for g in got], [digest(g[1]) for g in got], [digest(g[2]) for g in got]]

        return fn

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs, ["doc_id", "text"], struct(f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"), make)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: the key, its ids and the decoded text."""

    def make():
        tok = load(path)

        def fn(keys, texts):
            got = [tok.encode_text(t) for t in texts]
            return [keys, [[int(i) for i in g[1].split()] for g in got], [g[2] for g in got]]

        return fn

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs, ["doc_id", "text"], struct(f"doc_id {kind}, ids array<int>, decoded string"), make)
