"""SentencePiece BPE encoding by a prefix table, and decoding.

``PieceCoder`` reads the vocabulary of a public model. For a text it finds, with an automaton, all pieces that end at
each position. For every prefix there is exactly one piece that the merge procedure leaves last; it is the one piece
ending there which is compatible with the last piece of the prefix before it (two pieces are compatible when merging
their joined text gives the two again). The table of last pieces is filled left to right, and the ids are read from it
backwards. The work is linear in the text, however long a stretch without spaces is.

No piece holds the space mark behind another character, so stretches that begin at a space mark are independent; their
results are remembered in a bounded table. Pieces made of space marks alone share one score below all others: they
merge after everything else, from the left, which ``_space_run`` computes from the run's length.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import kept, small_batches, text_rows

MARK = "▁"


class PieceCoder:
    """Encoder and decoder over one model file; ``remembered`` bounds the number of results in each of its two tables,
    ``memory`` the bytes of that for words, which holds no word of more than ``longest`` characters."""

    longest = 200

    def __init__(self, model_file: str, remembered: int = 300_000, memory: int = 100 << 20):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.remembered, self.memory, self.used = remembered, memory, 0
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.byte_ids = [0] * 256
        self.byte_of: dict[int, int] = {}
        self.ids: dict[str, int] = {}
        score: dict[str, float] = {}
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)], self.byte_of[i] = i, int(piece[3:5], 16)
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece], score[piece] = i, model.get_score(i)
        #: Merges by falling score; equal scores outside the runs of space marks would need a look at positions.
        merged = sorted((p for p in score if len(p) > 1 and p.strip(MARK)), key=lambda p: -score[p])
        self.rank = {p: n for n, p in enumerate(merged)}
        self.tied = any(score[a] == score[b] for a, b in zip(merged, merged[1:], strict=False))
        if self.tied:  # equal scores merge from the left: equal ranks say so
            n = 0
            for a, b in zip(merged, merged[1:], strict=False):
                self.rank[a], n = n, n + (score[a] != score[b])
                self.rank[b] = n
        self.runs = {len(p) for p in score if len(p) > 1 and not p.strip(MARK)}
        if any(MARK in p.lstrip(MARK) or (p[:2] == MARK * 2 and p.strip(MARK)) for p in score):
            raise ValueError("a piece holds a space mark behind another character")
        self.letters = {c for p in score for c in p}
        #: Two characters that no piece holds side by side never end up in one piece.
        self.beside = {p[k : k + 2] for p in score for k in range(len(p) - 1)}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for p in [*self.rank, *self.letters]:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.id_text = {p: str(i) for p, i in self.ids.items()}
        self.fits: dict[tuple[str, str], bool] = {}
        self.known: dict[str, tuple[int, str, str]] = {}
        self.space_runs: dict[int, list[int]] = {}

    def _merge(self, text: str) -> list[str]:
        """The merge procedure itself, for two joined pieces at most."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = len(rank) + 1, -1
            for k in range(len(parts) - 1):
                if (r := rank.get(parts[k] + parts[k + 1], best)) < best:
                    best, at = r, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _compatible(self, left: str, right: str) -> bool:
        key = (left, right)
        if (known := self.fits.get(key)) is None:
            if len(self.fits) >= self.remembered:
                self.fits.clear()
            known = self.fits[key] = len(left) + len(right) == 1 or self._merge(left + right) == ([left, right] if left else [right])
        return known

    def _segment(self, text: str) -> list[str]:
        """Pieces of a stretch whose characters all occur in the vocabulary."""
        last: list[str] = [""] * (len(text) + 1)
        fits = self.fits.get
        for end, piece in self.automaton.iter(text):  # by end, the longest piece first
            end += 1
            if not last[end]:
                left = last[end - len(piece)]
                if (fit := fits((left, piece))) is None:
                    fit = self._compatible(left, piece)
                if fit:
                    last[end] = piece
        out, end = [], len(text)
        while end:
            if not (piece := last[end]):
                raise ValueError(f"no piece ends at {end} of {text[:100]!r}")
            out.append(piece)
            end -= len(piece)
        out.reverse()
        return out

    def _piece_ids(self, text: str) -> list[int]:
        """Ids of a stretch that holds space marks at its head only, one at most."""
        own = self.ids
        if self.letters.issuperset(text):
            ids = [own.get(piece, -1) for piece in self._segment(text)]
            if -1 not in ids:
                return ids
        ids = []
        start = 0
        for k in range(len(text) + 1):
            if k == len(text) or text[k] not in self.letters:
                for piece in self._segment(text[start:k]) if start < k else ():
                    ids.extend((self.ids[piece],) if piece in self.ids else (self.byte_ids[b] for b in piece.encode()))
                if k < len(text):
                    ids.extend(self.byte_ids[b] for b in text[k].encode("utf-8", "surrogatepass"))
                start = k + 1
        return ids

    def _space_run(self, n: int) -> list[int]:
        """Ids of n space marks: any two neighbours whose joined length is a piece merge, the leftmost first."""
        if (known := self.space_runs.get(n)) is not None:
            return known
        size, following, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(k, 1, 1) for k in range(n - 1)] if 2 in self.runs else []
        heapq.heapify(queue)
        while queue:
            k, a, b = heapq.heappop(queue)
            nxt = following[k]
            if size[k] != a or nxt >= n or size[nxt] != b:
                continue
            size[k], size[nxt], following[k] = a + b, 0, following[nxt]
            if following[k] < n:
                before[following[k]] = k
                if a + b + size[following[k]] in self.runs:
                    heapq.heappush(queue, (k, a + b, size[following[k]]))
            if before[k] >= 0 and size[before[k]] + a + b in self.runs:
                heapq.heappush(queue, (before[k], size[before[k]], a + b))
        one = [self.ids[MARK]] if MARK in self.ids else [self.byte_ids[b] for b in MARK.encode()]
        out: list[int] = []
        for s in size:
            out.extend(one if s == 1 else [self.ids[MARK * s]] if s else ())
        if len(self.space_runs) < 4096 and n < 4096:
            self.space_runs[n] = out
        return out

    def _learn(self, word: str) -> tuple[int, str, str]:
        """What a space mark and ``word`` give: number of ids, the ids, the text they decode to. With an empty head
        piece (the mark stays alone) the number is negative: a run of marks before it would take it in."""
        head, line, tail = word.partition("\n")
        if line and "\n" not in self.letters and head:  # a line end stands alone: both sides may be known
            left, right = self.known.get(head) or self._learn(head), self._after("\n" + tail)
            return self._keep(word, (left[0] + (-right[0] if left[0] < 0 else right[0]), left[1] + "," + right[1], left[2] + right[2]))
        end = len(word)
        while end > 2 and word[end - 1] in ",.;:!?)" and word[end - 2 : end] not in self.beside:
            end -= 1
        if end < len(word):  # marks at the end that join nothing
            left, right = self.known.get(word[:end]) or self._learn(word[:end]), [self._after(c) for c in word[end:]]
            n = sum(r[0] for r in right)
            return self._keep(word, (left[0] + (-n if left[0] < 0 else n), ",".join([left[1], *(r[1] for r in right)]), left[2] + "".join([r[2] for r in right])))
        if self.letters.issuperset(word) and MARK in self.ids:
            found, listed = self._segment(MARK + word), self.id_text
            if all([p in listed for p in found]):
                n = len(found)
                return self._keep(word, (-n if found[0] == MARK else n, ",".join([listed[p] for p in found]), "".join(found).replace(MARK, " ")))
        ids = self._piece_ids(MARK + word)
        alone = ids[0] == self.ids.get(MARK)
        got = (-len(ids) if alone else len(ids), ",".join(map(str, ids)), self._pieces_text(ids))
        return self._keep(word, got)

    def _after(self, text: str) -> tuple[int, str, str]:
        """The same for a stretch that cannot join with what stands before it; up to a space."""
        if (got := self.known.get(" " + text)) is None:  # no word holds a space
            got = self._keep(" " + text, self._given(self._piece_ids(text)))
        return got

    def _keep(self, word: str, got: tuple[int, str, str]) -> tuple[int, str, str]:
        if len(word) <= self.longest:
            if len(self.known) >= self.remembered or self.used > self.memory:
                self.known.clear()
                self.used = 0
            self.known[word] = got
            self.used += 400 + len(word) + len(got[1]) + 2 * len(got[2])  # the objects themselves take about 400
        return got

    def _stretches(self, text: str) -> list[tuple[int, str, str]]:
        words = text.replace(MARK, " ").split(" ")
        known, learn = self.known.get, self._learn
        if "" in words:
            return [x for x in self._spaced(words) if x[0]]
        return [known(word) or learn(word) for word in words]

    def _spaced(self, words: list[str]) -> Iterator[tuple[int, str, str]]:
        """The same where several spaces follow each other."""
        run = 0
        for k, word in enumerate(words):
            if word == "":
                run += 1
                if k + 1 == len(words):
                    yield self._given(self._space_run(run))
                continue
            got = self.known.get(word) or self._learn(word)
            if run and got[0] < 0:  # the mark stayed alone: it belongs to the run before it
                ids = self._space_run(run + 1)
                yield self._given(ids)
                rest = got[1].split(",")[1:]
                yield self._given([int(i) for i in rest])
            else:
                if run:
                    yield self._given(self._space_run(run))
                yield got
            run = 0

    def _given(self, ids: list[int]) -> tuple[int, str, str]:
        return len(ids), ",".join(map(str, ids)), self._pieces_text(ids)

    def _pieces_text(self, ids: list[int]) -> str:
        if self.byte_of.keys().isdisjoint(ids):
            return "".join([self.pieces[i] for i in ids]).replace(MARK, " ")
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.pieces[i].replace(MARK, " "))
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self._stretches(text) for i in ids.split(",")] if text else []

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, space marks as spaces, without the one that encoding puts first."""
        text = self._pieces_text(ids)
        return text[1:] if text[:1] == " " else text

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, sha256 of the ids, sha256 of the text that they decode to."""
        if not text:
            empty = hashlib.sha256(b"").hexdigest()
            return 0, empty, empty
        got = self._stretches(text)
        n, ids, back = sum([abs(x[0]) for x in got]), ",".join([x[1] for x in got]), "".join([x[2] for x in got])
        back = back[1:] if back[:1] == " " else back
        return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode("utf-8", "replace")).hexdigest()


def coder(model_file: str) -> PieceCoder:
    """One coder for each Python worker. Its tables hold no cycles, so the collector needn't walk them often."""

    def make() -> PieceCoder:
        code = PieceCoder(model_file)
        gc.freeze()
        gc.set_threshold(200_000, 50, 1000)
        return code

    return kept(("pieces", model_file), make)


def encode_texts(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each input row: its id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids and the
    decoded text. Null and empty texts give no ids and the digests of nothing. Repeated rows give repeated rows.
    Nothing is shuffled; a batch holds 256 texts."""
    rows = text_rows(df, id_col, text_col)
    small_batches(df.sparkSession)
    id_type = rows.schema["id"].dataType.simpleString()
    more = ", ids array<int>, decoded string" if with_ids else ""

    def run(batches):
        code = coder(model_file)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            got = [code.digest(t) for t in texts]
            columns = [batch.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                ids = [code.encode(t) for t in texts]
                columns += [pa.array(ids, pa.list_(pa.int32())), pa.array([code.decode(i) for i in ids], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, f"id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}").withColumnRenamed("id", id_col)
