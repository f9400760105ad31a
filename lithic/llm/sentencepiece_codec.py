"""SentencePiece encoding and decoding by suffix-array matching.

The distinct segments of a batch are concatenated and indexed by a suffix array (sorted to the longest piece's length);
every piece is binary-searched for its range of occurrences, the resulting edges are sorted by where they end in their
segment, and a relaxation fixes, place by place, the last piece of the encoding up to there. For a BPE model exactly one edge is
admissible at each place: the one that cannot have merged otherwise with the piece before it. So the result is the
model's own encoding, not just a cheapest cover.

A segment is a word with the blank before it; characters that no longer piece contains end a segment, so pieces never
cross segments. Runs of blanks are merged from the left into the longest blank pieces, as their equal scores demand.
Characters without a piece become byte pieces, or the unknown piece in a model without bytes.

The vocabulary is read once on the driver and sent to the tasks (its size is the model's). Null and empty texts have no
ids. Repeated rows are encoded each; other columns are passed on unless their name is that of a result, which is
replaced. Texts that hold the blank symbol itself come back with a blank in its place. Only BPE models are supported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithic.llm.common import bounded_batches, slices

BLANK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
INDEX_SEGMENTS = 60_000
INDEX_CHARS = 300_000
KEPT_SEGMENTS = 400_000
CACHE_BITS = 20
SLICE = 1_000_000  # bytes of text indexed together; every piece is searched in each index
BORDER = 0x110000  # after every segment; beyond Unicode


def merged(symbols: list[str], rank: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """BPE on a short list of symbols; also the last pair merged."""
    last = None
    while True:
        best = min(((rank[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in rank), default=None)
        if best is None:
            return symbols, last
        i = best[1]
        last = symbols[i], symbols[i + 1]
        symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]


class Vocabulary:
    """What encoding needs of a model, plain enough to be sent to tasks."""

    def __init__(self, model: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model)
        n = sp.vocab_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        self.unknown = sp.unk_id()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.bytes_at = next((i for i in range(n) if sp.is_byte(i)), None)
        self.decoded = [b"" if special[i] else bytes([i - self.bytes_at]) if sp.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.decoded[self.unknown] = " ⁇ ".encode()
        plain = [i for i in range(n) if not special[i] and not sp.is_byte(i)]
        self.blank_runs = {len(pieces[i]): i for i in plain if not pieces[i].strip(BLANK)}
        words = [i for i in plain if pieces[i].strip(BLANK) or pieces[i] == BLANK]
        singles = [i for i in words if len(pieces[i]) == 1]
        longer = sorted((i for i in words if len(pieces[i]) > 1), key=lambda i: (-sp.get_score(i), i))
        if any(BLANK in pieces[i][1:] for i in longer):
            raise ValueError(f"{model}: pieces that cross words are not supported")
        rank = {pieces[i]: len(singles) + r for r, i in enumerate(longer)}
        number = {pieces[i]: r for r, i in enumerate(singles)} | rank
        self.ids = np.array([*singles, *longer], np.int32)  # by rank
        self.split = np.tile(np.arange(len(number))[:, None], (1, 2))
        reachable = [True] * len(singles)
        for i in longer:
            whole, last = merged(list(pieces[i]), rank)
            reachable.append(len(whole) == 1)
            if last and last[0] in number and last[1] in number:
                self.split[rank[pieces[i]]] = number[last[0]], number[last[1]]
        pairs = [(number[p[:k]], number[p[k:]], r) for p, r in rank.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        key = np.array([a * len(number) + b for a, b, _ in pairs], np.int64)
        order = np.argsort(key)
        self.pair_keys, self.pair_rank = key[order], np.array([r for *_, r in pairs], np.int64)[order]
        self.pieces = [pieces[i] for i in self.ids]
        self.longest = max(map(len, self.pieces))
        self.usable = np.flatnonzero(reachable)
        self.joined = "".join(sorted(set("".join(p for p in self.pieces if len(p) > 1)) - {BLANK}))
        self.single = {p: r for p, r in number.items() if len(p) == 1}

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a and b (ranks) can stand side by side: undoing their merges from the inside out, no pair across the
        border may have come before the merge that hid it."""
        n = len(self.ids)
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b, limit = a.copy(), b.copy(), np.full(len(a), 1 << 40, np.int64)
        while len(live):
            at = np.minimum(np.searchsorted(self.pair_keys, a * n + b), len(self.pair_keys) - 1)
            clash = (self.pair_keys[at] == a * n + b) & (self.pair_rank[at] < limit)
            ok[live[clash]] = False
            left = a > b  # the younger of the two is undone
            new_a, new_b = np.where(left, self.split[a, 1], a), np.where(left, b, self.split[b, 0])
            new_limit = np.where(left, a, b + 1)
            stuck = (new_a == a) & (new_b == b)
            # the younger is a single character: undo the other
            other_a, other_b = np.where(left, a, self.split[a, 1]), np.where(left, self.split[b, 0], b)
            new_limit = np.where(stuck, np.where(left, b + 1, a), new_limit)
            done = stuck & (other_a == a) & (other_b == b)
            a, b = np.where(stuck, other_a, new_a), np.where(stuck, other_b, new_b)
            go = ~clash & ~done
            live, a, b, limit = live[go], a[go], b[go], new_limit[go]
        return ok


class Encoder:
    """Encodes batches in one Python worker; recent segments and compatibility answers are kept."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.v = vocabulary
        joined = f"[{re.escape(v.joined)}]+" if v.joined else r"(?!)"
        self.segment = re.compile(f"{BLANK}{joined}|{BLANK}+(?={BLANK}{joined})|{BLANK}+|{joined}|.", re.S)
        width = v.longest
        self.lengths = np.array([len(v.pieces[r]) for r in v.usable])
        self.codes = np.zeros((len(v.usable), width), np.uint32)
        for row, r in enumerate(v.usable):
            self.codes[row, : self.lengths[row]] = [ord(c) for c in v.pieces[r]]
        self.cache_key = np.full(1 << CACHE_BITS, -1, np.int64)
        self.cache_value = np.zeros(1 << CACHE_BITS, bool)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        self.size = 0

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * len(self.v.ids) + b
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        answer = self.cache_value[slot]
        miss = np.flatnonzero(self.cache_key[slot] != key)
        if len(miss):
            fresh, inverse = np.unique(key[miss], return_inverse=True)
            got = self.v.compatible(fresh // len(self.v.ids), fresh % len(self.v.ids))
            answer[miss] = got[inverse]
            self.cache_key[slot[miss]], self.cache_value[slot[miss]] = key[miss], got[inverse]
        return answer

    def suffix_array(self, text: np.ndarray) -> np.ndarray:
        """Places of the text sorted by the `longest` characters that follow, by prefix doubling."""
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
        width = 1
        while width < self.v.longest:
            ahead = np.zeros_like(rank)
            ahead[:-width] = rank[width:] + 1
            rank = np.unique(rank * (len(text) + 2) + ahead, return_inverse=True)[1]
            width *= 2
        return np.argsort(rank, kind="stable")

    def ranges(self, text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each usable piece the part of the suffix array that starts with it."""
        padded = np.concatenate([text, np.zeros(self.v.longest, text.dtype)])
        columns = np.arange(self.v.longest)
        inside = columns < self.lengths[:, None]
        bounds = []
        for upper in (False, True):
            low, high = np.zeros(len(self.codes), np.int64), np.full(len(self.codes), len(order), np.int64)
            while (low < high).any():
                mid = (low + high) // 2
                there = padded[order[np.minimum(mid, len(order) - 1)][:, None] + columns]
                unlike = (there != self.codes) & inside
                first = unlike.argmax(1)
                rows = np.arange(len(first))
                equal = ~unlike[rows, first]
                before = np.where(equal, upper, there[rows, first] < self.codes[rows, first])
                open_ = low < high
                low, high = np.where(open_ & before, mid + 1, low), np.where(open_ & ~before, mid, high)
            bounds.append(low)
        return bounds[0], bounds[1]

    def learn(self, segments: list[str]) -> None:
        """Encode segments not known yet and keep their ids."""
        sizes = np.array([len(s) for s in segments], np.int64)
        text = np.frombuffer("".join(s + "\0" for s in segments).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        begin = np.cumsum(sizes + 1) - sizes - 1
        text[begin + sizes] = BORDER
        order = self.suffix_array(text)
        low, high = self.ranges(text, order)
        n = high - low
        total = int(n.sum())
        place = order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(total)]
        piece = np.repeat(self.v.usable, n)
        end = place + np.repeat(self.lengths, n)
        owner = np.repeat(np.arange(len(segments)), sizes + 1)
        offset = np.arange(len(text)) - begin[owner]
        # characters without a piece are edges of their own
        char, inverse = np.unique(text, return_inverse=True)
        bare = np.array([c != BORDER and chr(c) not in self.v.single for c in char])[inverse]
        alone = np.flatnonzero(bare)
        place, end, piece = np.concatenate([place, alone]), np.concatenate([end, alone + 1]), np.concatenate([piece, np.full(len(alone), -1)])
        step = np.minimum(offset[end - 1] + 1, len(text))
        by_end = np.argsort(step, kind="stable")
        place, end, piece, step = place[by_end], end[by_end], piece[by_end], step[by_end]
        # last[b]: the piece of the encoding that ends at border b; -2 where a segment begins, -3 where there is none
        last = np.full(len(text) + 1, -3, np.int64)
        last[begin] = -2
        back = np.zeros(len(text) + 1, np.int64)
        cuts = np.flatnonzero(np.diff(step, prepend=0, append=-1))
        for a, b in zip(cuts, cuts[1:], strict=False):
            before, this = last[place[a:b]], piece[a:b]
            fits = (before == -2) | (before == -1) | ((this == -1) & (before > -3))
            ask = np.flatnonzero(~fits & (before >= 0))
            fits[ask] = self.compatible(before[ask], this[ask])
            chosen = np.flatnonzero(fits) + a
            last[end[chosen]], back[end[chosen]] = piece[chosen], place[chosen]
        # walk back from the ends of all segments at once
        border, live = begin + sizes, np.flatnonzero(sizes > 0)
        owners, borders = [], []
        while len(live):
            owners.append(live)
            borders.append(border[live])
            border[live] = back[border[live]]
            live = live[border[live] > begin[live]]
        if owners:
            who, where = np.concatenate(owners), np.concatenate(borders)
            sort = np.lexsort((where, who))
            who, where = who[sort], where[sort]
        else:
            who = where = np.zeros(0, np.int64)
        ranks = last[where]
        ids = np.where(ranks >= 0, self.v.ids[np.maximum(ranks, 0)], -1)
        if (ids < 0).any():
            pieces, owner_of = [], []
            for i, w, b in zip(ids.tolist(), who.tolist(), where.tolist(), strict=True):
                got = [i] if i >= 0 else self.bare_ids(chr(text[b - 1]))
                pieces += got
                owner_of += [w] * len(got)
            ids, who = np.array(pieces), np.array(owner_of)
        counts = np.bincount(who, minlength=len(segments))
        for k, s in enumerate(segments, len(self.known)):
            self.known[s] = k
        self.flat.append(ids.astype(np.int32))
        self.starts.append(self.size + np.cumsum(counts))
        self.size += len(ids)

    def bare_ids(self, c: str) -> list[int]:
        if self.v.bytes_at is None:
            return [self.v.unknown]
        return [self.v.bytes_at + b for b in c.encode("utf-8", "surrogatepass")]

    def blank_ids(self, n: int) -> list[int]:
        out = []
        while n:
            run = max(k for k in self.v.blank_runs if k <= n)
            out.append(self.v.blank_runs[run])
            n -= run
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [self.segment.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        lengths = np.array([len(s) for s in split], np.int64)
        codes, distinct = pd.factorize(np.array([s for part in split for s in part], dtype=object))
        distinct = list(distinct)
        new = [s for s in distinct if s not in self.known]
        if len(self.known) + len(new) > KEPT_SEGMENTS:
            self.forget()
            new = distinct
        a = 0
        while a < len(new):
            b, chars = a, 0
            while b < len(new) and b - a < INDEX_SEGMENTS and (b == a or chars + len(new[b]) <= INDEX_CHARS):
                chars += len(new[b])
                b += 1
            self.learn(new[a:b])
            a = b
        flat, starts = np.concatenate(self.flat), np.concatenate(self.starts)
        self.flat, self.starts = [flat], [starts]
        at = np.array([self.known[s] for s in distinct], np.int64)[codes] if len(codes) else codes.astype(np.int64)
        n = starts[at + 1] - starts[at]
        take = np.repeat(starts[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        ids = flat[take]
        # borders of texts in the flat ids
        upto = np.concatenate([[0], np.cumsum(n)])
        ends = upto[np.cumsum(lengths)]
        out = np.split(ids, ends[:-1]) if len(texts) else []
        first = np.concatenate([[0], np.cumsum(lengths)])
        for i, part in enumerate(split):
            if texts[i] and (BLANK * 2 in part[0] or "  " in texts[i] or texts[i][0] == " " or BLANK in texts[i]):
                out[i] = self.with_blank_runs(part, [flat[starts[k] : starts[k + 1]] for k in at[first[i] : first[i + 1]]])
        return out

    def with_blank_runs(self, segments: list[str], ids: list[np.ndarray]) -> np.ndarray:
        """A run of blanks takes in a following word's own blank where that stays alone."""
        out, run = [], 0
        blank = self.v.blank_runs.get(1)
        for s, x in zip(segments, ids, strict=True):
            if not s.strip(BLANK):
                run += len(s)
                continue
            x = x.tolist()
            if run and s[0] == BLANK and x[:1] == [blank]:
                run, x = run + 1, x[1:]
            out += self.blank_ids(run) + x
            run = 0
        return np.array(out + self.blank_ids(run), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.v.decoded.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_encoders: dict[str, Encoder] = {}


def encoder(key: str, vocabulary: Vocabulary) -> Encoder:
    """One encoder per Python worker and model."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def encode(docs: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """The columns of docs with token_ids, n_tokens and round_trip (decoding the ids gives the text back)."""
    bounded_batches(docs.sparkSession)
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(model))  # the model's size
    kept = [c for c in docs.columns if c not in ("token_ids", "n_tokens", "round_trip")]
    schema = docs.select(*kept).schema.add("token_ids", T.ArrayType(T.IntegerType())).add("n_tokens", T.LongType()).add("round_trip", T.BooleanType())
    at = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model, vocabulary.value)
        for rows in slices(batches, at, SLICE):
            texts = rows.column(at).to_pylist()
            ids = coder.encode(texts)
            same = [coder.decode(x) == (t or "") for x, t in zip(ids, texts, strict=True)]
            sizes = np.array([len(x) for x in ids], np.int64)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if len(ids) else np.zeros(0, np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in range(len(kept))), lists, pa.array(sizes), pa.array(same, pa.bool_())], names=schema.names)

    return docs.select(*kept).mapInArrow(run, schema)


def decode(rows: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """The columns of rows with `decoded`, the text that token_ids stand for; null ids decode to empty text."""
    vocabulary = rows.sparkSession.sparkContext.broadcast(Vocabulary(model))

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        coder = encoder(model, vocabulary.value)
        return ids.map(lambda x: coder.decode(np.asarray(x, np.int32)) if x is not None else "")

    return rows.withColumn("decoded", text("token_ids"))
