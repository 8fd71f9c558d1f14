"""SentencePiece BPE encoding and decoding by vectorised merge rounds."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import run_on_texts, table

#: The space's stand-in in pieces.
SPACE = "▁"
#: Cached words at most; the cache starts anew beyond, which costs time but no result.
CACHE_WORDS = 300_000
#: Longer words are encoded but not cached.
CACHE_CHARS = 64
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) pairs of a protobuf message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        yield key >> 3, value


class Pieces:
    """A BPE model file with byte fallback, an identity normaliser and a dummy prefix."""

    def __init__(self, model: bytes):
        pieces, trainer, normaliser = [], {}, {}
        for f, v in _fields(model):
            if f == 1:
                d = dict(_fields(v))
                score = float(np.frombuffer(d.get(2, b"\0\0\0\0"), "<f4")[0])
                pieces.append((d.get(1, b"").decode(), score, d.get(3, _NORMAL)))
            elif f == 2:
                trainer = dict(_fields(v))
            elif f == 3:
                normaliser = dict(_fields(v))
        supported = trainer.get(3) == 2 and trainer.get(35) == 1 and not normaliser.get(2) and normaliser.get(3, 1) == 1 and not normaliser.get(4, 1)
        if not supported or any(k in (_USER, _UNUSED) for _, _, k in pieces):
            raise ValueError("only BPE with byte fallback, an identity normaliser and a dummy prefix is supported")
        self.text = [p for p, _, _ in pieces]
        self.kind = np.array([k for _, _, k in pieces])
        normal = [(p, s, i) for i, (p, s, k) in enumerate(pieces) if k == _NORMAL]
        self.ids = {p: i for p, _, i in normal}
        self.byte = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == _BYTE}
        self.value = {i: v for v, i in self.byte.items()}
        # symbols: characters of pieces and pieces; a pair that forms a piece has its rank
        # pieces of equal score have one rank: the leftmost of their pairs is merged first
        by_score = sorted(normal, key=lambda x: (-x[1], x[2]))
        level = {s: r for r, s in enumerate(sorted({s for _, s, _ in normal}, reverse=True))}
        rank = {p: level[s] for p, s, _ in by_score}
        chars = sorted({c for p, _, _ in normal for c in p})
        self.symbol = {c: i for i, c in enumerate(chars)}
        for p, _, _ in by_score:
            self.symbol.setdefault(p, len(self.symbol))
        self.symbols = list(self.symbol)
        pairs = []
        for p, r in rank.items():
            for k in range(1, len(p)):
                a, b = p[:k], p[k:]
                if a in self.symbol and b in self.symbol:
                    pairs.append((self.symbol[a], self.symbol[b], r, self.symbol[p]))
        self.width = len(self.symbols) + 1
        table_ = np.array(sorted((a * self.width + b, r, s) for a, b, r, s in pairs), np.int64).reshape(-1, 3)
        self.pair, self.rank, self.product = table_[:, 0].copy(), table_[:, 1].copy(), table_[:, 2].copy()
        # a product that can go on to a pair of no higher rank than its own has to be merged one
        # at a time, as the new pair then comes first
        own = np.full(len(self.symbols), -1)
        for p, r in rank.items():
            own[self.symbol[p]] = r
        self.alone = np.zeros(len(level) + 1, bool)
        for a, b, r, _ in pairs:
            for part in (a, b):
                if len(self.symbols[part]) > 1 and own[part] >= r:
                    self.alone[own[part]] = True
        self.piece_id = np.array([self.ids.get(s, -1) for s in self.symbols])
        # a character's symbol, or -1 - its code where no piece has it
        self.by_code = -1 - np.arange(0x110000, dtype=np.int64)
        for c in chars:
            self.by_code[ord(c)] = self.symbol[c]
        self.digits = [str(i) for i in range(len(pieces))]
        self.plain = [bytes([self.value[i]]) if i in self.value else t.replace(SPACE, " ").encode() for i, t in enumerate(self.text)]
        inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        # no piece goes on after a space's stand-in or holds a line end: texts fall apart there
        self.cut = re.compile("[\\s\\S]+" if inner else f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if "\n" not in self.symbol else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.cache: dict[str, tuple[str, int, bytes]] = {}
        self.older: dict[str, tuple[str, int, bytes]] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and product of neighbours; the rank is the number of pieces where there is none."""
        none = len(self.alone) - 1
        if not len(self.pair):
            return np.full(len(left), none), np.zeros(len(left), np.int64)
        want = left * self.width + right
        at = np.minimum(np.searchsorted(self.pair, want), len(self.pair) - 1)
        hit = (self.pair[at] == want) & (left >= 0) & (right >= 0)
        return np.where(hit, self.rank[at], none), self.product[at]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words after all merges, and where each word's end; characters outside
        the vocabulary are -1 - code.

        All words lie in one flat array. Each round finds every word's least pair rank, merges
        that rank's pairs in all words at once, leftmost first where they overlap, and drops
        the merged places; words without a pair leave.
        """
        none = len(self.alone) - 1
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym = self.by_code[codes]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done_sym, done_word = [], []
        rank, product = self.ranks(sym[:-1], sym[1:])
        rank[word[:-1] != word[1:]] = none
        rank, product = np.r_[rank, none][: len(sym)], np.r_[product, 0][: len(sym)]
        while len(sym):
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, start)
            active = least < none
            size = np.diff(np.r_[start, len(sym)])
            if not active.all():
                keep = np.repeat(active, size)
                done_sym.append(sym[~keep])
                done_word.append(word[~keep])
                sym, word, rank, product = sym[keep], word[keep], rank[keep], product[keep]
                least, size = least[active], size[active]
                if not len(sym):
                    break
            best = np.repeat(least, size)
            at = np.flatnonzero(rank == best)
            # runs of overlapping pairs: every other one from the left
            new_run = np.r_[True, (np.diff(at) > 1)]
            first = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            lone = self.alone[rank[at]]
            if lone.any():
                w = word[at]
                at = at[~lone | np.r_[True, w[1:] != w[:-1]]]
            sym[at] = product[at]
            gone = np.ones(len(sym), bool)
            gone[at + 1] = False
            touched = np.zeros(len(sym), bool)
            touched[at] = True
            before = at - 1
            # the pair before a merge starts at the last place that stays
            before = before[before >= 0]
            before = np.where(gone[before], before, before - 1)
            touched[before[before >= 0]] = True
            sym, word, rank, product, touched = sym[gone], word[gone], rank[gone], product[gone], touched[gone]
            t = np.flatnonzero(touched)
            nxt = np.minimum(t + 1, len(sym) - 1)
            r, p = self.ranks(sym[t], sym[nxt])
            r[(nxt == t) | (word[nxt] != word[t])] = none
            rank[t], product[t] = r, p
        if not done_sym:
            return np.empty(0, np.int64), np.zeros(len(words), np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        return sym[np.argsort(word, kind="stable")], np.cumsum(np.bincount(word, minlength=len(words)))

    def ids_of(self, sym: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of symbols, and where each word's end; what is no piece becomes the bytes
        of its UTF-8."""
        ids = np.where(sym >= 0, self.piece_id[np.maximum(sym, 0)], -1)
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids, ends
        text = [self.symbols[s] if s >= 0 else chr(-1 - s) for s in sym[odd].tolist()]
        fall = [[self.byte[b] for b in t.encode("utf-8", "replace")] for t in text]
        size = np.ones(len(ids), np.int64)
        size[odd] = [len(f) for f in fall]
        total = np.cumsum(size)
        out = np.repeat(ids, size)
        out[out < 0] = [i for f in fall for i in f]
        return out, total[ends - 1]

    def units(self, text: str) -> list[str]:
        if not text:
            return []
        return self.cut.findall(SPACE + text.replace(" ", SPACE))

    def learn(self, units: set[str]) -> dict[str, tuple[str, int, bytes]]:
        """(ids joined by commas, number of ids, decoded UTF-8) of units, from the cache or anew.

        The cache has two generations: words met since the last turn, and those met before.
        """
        if len(self.cache) > CACHE_WORDS:
            self.cache, self.older = {}, self.cache
        cache, older = self.cache, self.older
        got, rest = {}, []
        for u in units:
            v = cache.get(u)
            if v is None:
                v = older.get(u)
                if v is None:
                    rest.append(u)
                    continue
                cache[u] = v
            got[u] = v
        digits, plain = self.digits, self.plain
        for i in range(0, len(rest), 20_000):
            part = rest[i : i + 20_000]
            ids, ends = self.ids_of(*self.merge(part))
            ids, at = ids.tolist(), 0
            text, raw = [digits[k] for k in ids], [plain[k] for k in ids]
            for u, to in zip(part, ends.tolist()):
                v = (",".join(text[at:to]), to - at, b"".join(raw[at:to]))
                got[u] = v
                if len(u) <= CACHE_CHARS:
                    cache[u] = v
                at = to
        return got

    def encode(self, text: str) -> list[int]:
        units = self.units(text)
        known = self.learn(set(units))
        return [int(i) for u in units for i in known[u][0].split(",")]

    def raw(self, ids: list[int]) -> bytes:
        """UTF-8 of ids, the stand-ins turned to spaces."""
        return b"".join([self.plain[i] for i in ids])

    @staticmethod
    def finish(raw: bytes) -> bytes:
        """The text of decoded UTF-8: without the dummy prefix, stray bytes replaced one by one."""
        raw = raw[1:] if raw[:1] == b" " else raw
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            out, at = [], 0
            while at < len(raw):
                try:
                    out.append(raw[at:].decode())
                    break
                except UnicodeDecodeError as e:
                    out.append(raw[at : at + e.start].decode() + "�")
                    at += e.start + 1
            return "".join(out).encode()

    def decode(self, ids: list[int]) -> str:
        return self.finish(self.raw([i for i in ids if self.kind[i] != _CONTROL])).decode()


def model_bytes(path: str | None = None) -> bytes:
    """The model file at ``path``; by default the installed public one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encode every whole text as the library does, without begin or end ids, then decode.

    Returns doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (and
    ids with ``with_ids``), one row for each row of ``docs``. Null texts count as empty, which
    has no ids; null ids and repeated rows keep their rows; an empty table gives none; other
    columns, whatever their names, are ignored. The model is read once on the driver and sent to the executors.
    """
    model = docs.sparkSession.sparkContext.broadcast(model_bytes(path))
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = Pieces(model.value)
        for pdf in batches:
            texts, ids = pdf["text"].tolist(), pdf["doc_id"].tolist()
            at = 0
            while at < len(texts):  # batches of bounded size in characters
                to, chars = at, 0
                while to < len(texts) and (to == at or chars + len(texts[to] or "") < 2_000_000):
                    chars += len(texts[to] or "")
                    to += 1
                cut = [pieces.units(t or "") for t in texts[at:to]]
                known = pieces.learn(set().union(*cut))
                rows = []
                for units in cut:
                    got = [known[u] for u in units]
                    joined = ",".join([g[0] for g in got])
                    rows.append((sum([g[1] for g in got]), sha(joined.encode()), sha(pieces.finish(b"".join([g[2] for g in got]))), joined))
                out = pd.DataFrame({"doc_id": pd.Series(ids[at:to], dtype=pdf["doc_id"].dtype), "n_tokens": [r[0] for r in rows], "ids_sha256": [r[1] for r in rows], "decoded_sha256": [r[2] for r in rows]})
                if with_ids:
                    out["ids"] = [[int(i) for i in r[3].split(",")] if r[3] else [] for r in rows]
                yield out
                at = to

    kind = docs.schema["doc_id"].dataType.simpleString()
    return run_on_texts(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInPandas(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids))


def op4_merge_rounds(spark, sf_dir):
    return encode_documents(table(spark, sf_dir, "documents"))
