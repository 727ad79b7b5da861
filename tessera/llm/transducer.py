"""BPE as a streaming transducer: tokens leave as soon as no further text can change them."""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _blocks
from .common import packed, quoted, without
from .pieces import PieceIds, gather, per_worker, spans

#: Text bytes that are split at once, of some documents or of one long one.
STEP_BYTES = 4 << 20
#: Distinct words, and pieces of them, that a Python worker carries on.
HELD = 250_000
#: Ids that are decoded at once, and documents in an Arrow batch.
STEP_IDS, ROWS_OUT = 1 << 16, 256

_NONE = np.iinfo(np.int32).max


def _byte_names() -> list[str]:
    """The characters that byte-level vocabularies write for bytes: printable ones stay, the others follow 255."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class Merges:
    """Merges in rank order over symbols, which are bytes and bytes that close a piece, and how far text ahead can matter.

    ``lookahead`` is sufficient: with n symbols of a piece read, its tokens that end at or before n - lookahead are final.
    What follows symbol n can first matter to a merge whose right token starts there; that merge takes in its left
    token, and what it makes of this can matter to a merge of higher rank whose right token is, or was grown from, that left token; and so on to the
    left. So the reach of a merge is the length of its left token and the greatest reach of earlier merges whose left token starts its right
    one; the lookahead is the greatest reach of all. Ranks must build on one another, each merge making a token of its own: so no merge can follow one of a higher rank.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError(f"{path}: not a plain byte-level BPE")
        vocab, close = model["vocab"], model.get("end_of_word_suffix") or ""
        self.names = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens that take in what is next to them")
        self.close, names = close, _byte_names()
        self.open_byte = np.array([vocab[c] for c in names], np.int32)
        self.last_byte = np.array([vocab[c + close] for c in names], np.int32)
        bare = lambda t: t[: len(t) - len(close)] if close and t.endswith(close) else t
        size = {i: 1 for i in [*self.open_byte.tolist(), *self.last_byte.tolist()]}
        starts: dict[int, int] = {}  # the left token of the merge that made a token
        reach: dict[int, int] = {}  # greatest reach so far of merges with this left token
        codes, made, self.lookahead = [], [], 0
        for pair in model["merges"]:
            x, y = pair if isinstance(pair, list) else pair.split(" ")
            a, b, c = vocab[x], vocab[y], vocab[x + y]
            if a not in size or b not in size or c in size:
                raise ValueError(f"{path}: merge of {x!r} and {y!r} does not build on earlier ones")
            t, most = b, 0
            while t is not None:
                most = max(most, reach.get(t, 0))
                t = starts.get(t)
            size[c], starts[c] = len(bare(x + y)), a
            reach[a] = max(reach.get(a, 0), size[a] + most)
            self.lookahead = max(self.lookahead, reach[a])
            codes.append(a << 32 | b)
            made.append(c)
        order = np.argsort(np.array(codes, np.int64))
        self.codes, self.ranks, self.made = np.append(np.array(codes, np.int64)[order], np.iinfo(np.int64).max), np.append(order, _NONE).astype(np.int32), np.array(made, np.int32)
        self.sizes = np.zeros(max(self.names) + 1, np.int64)
        self.sizes[list(size)] = list(size.values())

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.codes, code)
        return np.where(self.codes[at] == code, self.ranks[at], _NONE)

    def merge(self, symbols: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all pieces end to end, tokens per piece): in each piece, all places of its least merge, again and again."""
        tok, word = symbols.astype(np.int32), np.repeat(np.arange(len(lens)), lens)
        done_tok, done_word = [], []
        rank = np.full(len(tok), _NONE, np.int32)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self._rank(tok[inner], tok[inner + 1])
        while len(tok):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(tok))))
            live = least < _NONE
            if not live.any():
                break
            if live.mean() < 0.7:
                done_tok.append(tok[~live])
                done_word.append(word[~live])
                tok, word, rank, least = tok[live], word[live], rank[live], least[live]
            hit = np.flatnonzero((rank == least) & (least < _NONE))
            beside = np.flatnonzero(np.diff(hit) == 1)
            if len(beside):  # as in "aaa": from the left, every second one of a run
                apart = np.ones(len(hit), bool)
                apart[beside + 1] = False
                place = np.arange(len(hit))
                hit = hit[(place - np.maximum.accumulate(np.where(apart, place, 0))) % 2 == 0]
            tok[hit] = self.made[rank[hit]]
            stays = np.ones(len(tok), bool)
            stays[hit + 1] = False
            now = np.cumsum(stays)[hit] - 1
            tok, word, rank = tok[stays], word[stays], rank[stays]
            touched = np.zeros(len(tok), bool)
            touched[now], touched[now[now > 0] - 1] = True, True
            near = np.flatnonzero(touched)
            rank[near] = _NONE
            near = near[near + 1 < len(tok)]
            near = near[word[near] == word[near + 1]]
            rank[near] = self._rank(tok[near], tok[near + 1])
        tok, word = np.concatenate([*done_tok, tok]), np.concatenate([*done_word, word])
        order = np.argsort(word, kind="stable")
        return tok[order], np.bincount(word, minlength=len(lens))

    @property
    def window(self) -> int:
        """Symbols of one piece that are held at once."""
        return 4 * self.lookahead + 256

    def _long(self, pieces: list[np.ndarray]) -> list[np.ndarray]:
        """Tokens of long pieces, each from a window that moves on behind its last final token; all windows are merged in step."""
        at, out, open_ = [0] * len(pieces), [[] for _ in pieces], list(range(len(pieces)))
        while open_:
            parts = [pieces[i][at[i] : at[i] + self.window] for i in open_]
            flat, count = self.merge(np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts)))
            for i, tok in zip(open_, np.split(flat, np.cumsum(count)[:-1]), strict=True):
                if at[i] + self.window < len(pieces[i]):
                    ends = np.cumsum(self.sizes[tok])
                    tok = tok[: int(np.searchsorted(ends, self.window - self.lookahead, "right"))]
                    at[i] += int(ends[len(tok) - 1])
                else:
                    at[i] = len(pieces[i])
                out[i].append(tok)
            open_ = [i for i in open_ if at[i] < len(pieces[i])]
        return [np.concatenate(o) for o in out]

    def pieces(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all pieces end to end, tokens per piece); no piece is empty."""
        if not raw:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = spans(lens)
        symbols = self.open_byte[data]
        symbols[ends[1:] - 1] = self.last_byte[data[ends[1:] - 1]]
        long = lens > self.window
        flat, count = self.merge(symbols[np.repeat(~long, lens)], lens[~long])
        if not long.any():
            return flat, count
        which = np.flatnonzero(long).tolist()
        own = dict(zip(which, self._long([symbols[ends[i] : ends[i + 1]] for i in which]), strict=True))
        all_count = np.zeros(len(raw), np.int64)
        all_count[~long], all_count[long] = count, [len(t) for t in own.values()]
        parts = iter(np.split(flat, np.cumsum(count)[:-1]))
        return np.concatenate([own[i] if i in own else next(parts) for i in range(len(raw))]), all_count


class Encoder:
    """Ids of texts: words between single spaces are normalised and split by the tokenizer's own rules once, their pieces go through ``Merges``.

    White space has no tokens and no rule looks across it, so the ids of a text are those of its words. Special tokens are taken from the raw text.
    """

    def __init__(self, path: str, held: int = HELD) -> None:
        from tokenizers import Tokenizer

        self.merges, tokenizer = Merges(path), Tokenizer.from_file(path)
        self.normalise, self.split = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        with open(path, encoding="utf-8") as f:
            self.plain = regex.compile(_ascii_rule(json.load(f)))
        self.byte = {c: b for b, c in enumerate(_byte_names())}
        self.known_pieces = PieceIds(self.merges.pieces, held)
        self.known_words = PieceIds(self._words, held)

    def start(self) -> None:
        self.known_pieces.start()
        self.known_words.start()

    def _cut(self, word: str) -> list[bytes]:
        if word.isascii():
            return self.plain.findall(word.lower().encode())
        return [bytes(map(self.byte.__getitem__, p)) for p, _ in self.split(self.normalise(word))]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        special = self.merges.special
        cut = [[] if w in special else self._cut(w) for w in words]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        flat, lens = self.known_pieces.ids(self.known_pieces.add([p for c in cut for p in c]))
        own = np.diff(spans(lens)[spans(sizes)])
        marks = [(i, special[w]) for i, w in enumerate(words) if w in special]
        if marks:
            at = spans(own)[[i for i, _ in marks]]
            flat = np.insert(flat, at, [m for _, m in marks])
            own[[i for i, _ in marks]] = 1
        return flat, own

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, ids per text)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        for s in self.merges.special:
            if pc.any(pc.match_substring(texts, s)).as_py():
                texts = pc.replace_substring(texts, s, f" {s} ")
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        self.start()
        numbers = self.known_words.add(coded.dictionary.to_pylist())
        flat, lens = self.known_words.ids(numbers[coded.indices.to_numpy()])
        return flat, np.diff(spans(lens)[split.offsets.to_numpy() - split.offsets[0].as_py()])


def _ascii_rule(spec: dict) -> bytes:
    """The rule that cuts words, for ASCII bytes; checked to be the one that this module knows, with white space dropped."""
    kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
    cut, level = spec["pre_tokenizer"]["pretokenizers"]
    if kinds != ["NFC", "Replace", "Lowercase"] or not (cut["type"] == "Split" and cut["invert"] and cut["behavior"] == "Removed") or level["use_regex"] or level["add_prefix_space"]:
        raise ValueError("a tokenizer of another kind")
    rule = cut["pattern"]["Regex"]
    for name, range_ in (("\\p{L}", "a-zA-Z"), ("\\p{N}", "0-9")):
        rule = rule.replace(f"[{name}]", f"[{range_}]").replace(name, range_)
    # White space of ASCII as the library counts it: not the separators 0x1C to 0x1F.
    return rule.replace("\\s", "\\x09-\\x0d\\x20").encode()


def _windows(text: str, most: int) -> Iterator[str]:
    """A long text in parts, cut at spaces where it has them; a special token has no space and stays whole."""
    at = 0
    while len(text) - at > most:
        cut = text.find(" ", at + most)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def _encoder(path: str, step_bytes: int, held: int, form: str | None = None):
    """With a ``form``, ids are decoded again in the same worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(("transducer", path, held), lambda: Encoder(path, held))
        machine = form and Decoder(encoder.merges, form)
        for block in _blocks(batches, step_bytes):
            row = block["row"].combine_chunks()
            row = row.chunk(0) if isinstance(row, pa.ChunkedArray) else row
            text = block["text"].combine_chunks()
            text = pa.concat_arrays(text.chunks) if isinstance(text, pa.ChunkedArray) else text
            if block.num_rows == 1 and text.nbytes > 2 * step_bytes:
                parts = [encoder.texts(pa.array([w]))[0] for w in _windows(text[0].as_py(), step_bytes)]
                flat, lens = np.concatenate(parts), np.array([sum(map(len, parts))])
            else:
                flat, lens = encoder.texts(text)
            ends = spans(lens)
            for i in range(0, len(lens), ROWS_OUT):
                j = min(i + ROWS_OUT, len(lens))
                ids = pa.ListArray.from_arrays(pa.array((ends[i : j + 1] - ends[i]).astype(np.int32)), pa.array(flat[ends[i] : ends[j]].astype(np.int32)))
                decoded = {"decoded": _texts(machine, ids)} if machine else {}
                yield pa.RecordBatch.from_arrays([row.slice(i, j - i), ids, *decoded.values()], ["row", "ids", *decoded])

    return run


def encode(docs: DataFrame, path: str, carry: list[str] | None = None, step_bytes: int = STEP_BYTES, held: int = HELD, text_col: str = "text") -> DataFrame:
    """Add ids: what the tokenizers library makes of each whole text with the file ``path``, without added special tokens.

    A narrow step. A task holds a block of texts (or one longer text, which is split window by window), a bounded number of known words, and of a piece
    of any length ``Merges.window`` symbols. Null and empty texts have no ids; a special token in a text is that token. Returns the ``carry`` columns
    (default: all; one named ids is replaced).
    """
    kept = docs.select(*quoted(*(carry if carry is not None else docs.columns)))
    rows = docs.select(packed(kept, "ids").alias("row"), quoted(text_col)[0].alias("text"))
    schema = rows.select("row", F.array(F.lit(0)).alias("ids")).schema
    return rows.mapInArrow(_encoder(path, step_bytes, held), schema).select(*[F.col("row").getField(c).alias(c) for c in without(kept, "ids")], "ids")


class Decoder:
    """A state machine from ids to text, fed with any number of ids at a time.

    Its state is the bytes of a character that is not complete, and whether something came before. ``tokens`` writes tokens as the vocabulary
    names them, one space between two (what the library does for a file without decoder); ``text`` writes the bytes that they stand for, a space for
    the end of a word, and U+FFFD for bytes that are no UTF-8. Ids without a token are skipped.
    """

    def __init__(self, merges: Merges, form: str) -> None:
        byte, special = {c: b for b, c in enumerate(_byte_names())}, set(merges.special.values())
        each = [b""] * (max(merges.names) + 1)
        for i, name in merges.names.items():
            if form == "tokens":
                each[i] = f" {name}".encode()
            elif i in special:
                each[i] = name.encode()
            else:
                closed = bool(merges.close) and name.endswith(merges.close)
                bare = name[: -len(merges.close)] if closed else name
                each[i] = bytes(byte[c] for c in bare) + b" " * closed
        self.skip, self.top = (1 if form == "tokens" else 0), len(each)
        self.lens = np.fromiter(map(len, each), np.int64, len(each))
        self.flat, self.starts = np.frombuffer(b"".join(each), np.uint8), spans(self.lens)[:-1]
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")
        self.reset()

    def reset(self) -> None:
        self.machine.reset()
        self.left = self.skip

    def feed(self, ids: np.ndarray, last: bool = False) -> str:
        ids = ids[(ids >= 0) & (ids < self.top)]
        out = self.machine.decode(gather(self.flat, self.starts[ids], self.lens[ids]).tobytes(), last)
        if self.left and out:
            out, self.left = out[self.left :], 0
        return out


def _texts(machine: Decoder, part: pa.ListArray) -> pa.Array:
    """The text of each list of ids; null lists have none."""
    part = part.fill_null([]) if part.null_count else part
    ids, ends, out = part.flatten().to_numpy(), spans(np.asarray(part.value_lengths().to_numpy(zero_copy_only=False), np.int64)), []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        machine.reset()
        out.append("".join([machine.feed(ids[k : min(k + STEP_IDS, b)]) for k in range(a, b, STEP_IDS)]) + machine.feed(ids[:0], True))
    return pa.array(out, pa.string())


def _decoder(path: str, form: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Decoder(per_worker(("merges", path), lambda: Merges(path)), form)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS_OUT):
                yield pa.RecordBatch.from_arrays([batch["row"].slice(i, ROWS_OUT), _texts(machine, batch["ids"].slice(i, ROWS_OUT))], ["row", "decoded"])

    return run


def decode(docs: DataFrame, path: str, form: str = "tokens", ids_col: str = "ids") -> DataFrame:
    """Add decoded: the text of each row's ids in the given ``form`` (see ``Decoder``). Null or no ids give an empty text."""
    rows = docs.select(packed(docs, "decoded").alias("row"), quoted(ids_col)[0].alias("ids"))
    schema = rows.select("row", F.lit("").alias("decoded")).schema
    return rows.mapInArrow(_decoder(path, form), schema).select(*[F.col("row").getField(c).alias(c) for c in without(docs, "decoded")], "decoded")


def round_trip(docs: DataFrame, path: str, form: str = "tokens", carry: list[str] | None = None, step_bytes: int = STEP_BYTES, held: int = HELD, text_col: str = "text") -> DataFrame:
    """Add ids and decoded: what ``encode`` and then ``decode`` add, in one step, so that a task has one Python worker and ids are sent once."""
    kept = docs.select(*quoted(*(carry if carry is not None else docs.columns)))
    rows = docs.select(packed(kept, "ids", "decoded").alias("row"), quoted(text_col)[0].alias("text"))
    schema = rows.select("row", F.array(F.lit(0)).alias("ids"), F.lit("").alias("decoded")).schema
    return rows.mapInArrow(_encoder(path, step_bytes, held, form), schema).select(*[F.col("row").getField(c).alias(c) for c in without(kept, "ids", "decoded")], "ids", "decoded")
