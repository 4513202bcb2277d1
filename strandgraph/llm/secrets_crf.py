"""Secret scans: fixed patterns, and a linear-chain conditional random field over all tokens of a text.

A token is a run of letters, digits and + / _ . - (then any =), of any length. The field tags every token as secret
begin (B), inside (I) or outside (O) from its shape, the words and signs beside it and features of the whole text. A text
is one chain, decoded by Viterbi; the only constraint is that I follows B or I.

Nearly every token of a text is plain prose, so the decoder first finds the tokens that are O on every best path: where
O is ahead by more than any change of neighbouring tags could make up (see Field.certain). They cut the chain into short
pieces, and decoding these is decoding the whole chain, exactly. What a token, its neighbours and the signs between them
contribute is worked out once for each different token (for plain words that the field doesn't know: once for each length
and case) and gathered with numpy.

The field is trained by gradient ascent on the likelihood of generated lines with secrets of many forms and with what looks
alike but isn't secret (numbers, dates, addresses, paths, versions, identifiers, prose about passwords); the generator's seed
is fixed, so every run has the same model and no text of the corpus takes part.
"""

from __future__ import annotations

import functools
import math
import random
import re
import string
from collections import Counter
from collections.abc import Callable, Collection, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.llm import common

#: Kinds of spans in the order in which spans of equal start are listed.
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Splits a text into signs, token, signs, token, ..., signs.
TOKEN = re.compile(r"([\w+/.\-]+=*)")
MASK = "[secret]"
#: Different tokens whose contributions are kept in a Python worker from one text to the next.
KEPT = 200_000


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping for each kind."""
    out = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


# ---- features ----------------------------------------------------------------------------------------------------


def file_features(text: str) -> list[str]:
    """Features of a whole text."""
    n = max(len(text), 1)
    signs = text.count("=") + text.count("{") + text.count(";") + text.count("#")
    return [f"file:signs{min(4, int(200 * signs / n))}"]


def _classes(token: str) -> str:
    return "".join("d" if c in string.digits else "u" if c.isupper() else "l" if c.isalpha() else c for c in token)


def _case(body: str) -> str:
    """How a word of letters only is written; empty for anything else."""
    if not body.isalpha():
        return ""
    return "lower" if body.islower() else "title" if body[0].isupper() and body[1:].islower() else "upper" if body.isupper() else ""


def shape_features(token: str) -> list[str]:
    """Features of the token itself."""
    body = token.rstrip("=.-")
    n = len(body)
    if case := _case(body):
        return ["bias", f"case:{case}", f"case+len:{case}{min(10, n // 4)}", f"ascii:{body.isascii()}", f"equals:{min(2, len(token) - len(token.rstrip('=')))}", f"word:{body.lower()[:20]}"]
    kinds = _classes(body)
    counts = Counter(kinds)
    digits, upper, lower = counts["d"], counts["u"], counts["l"]
    turns = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    entropy = int(-2 * sum(c / n * math.log2(c / n) for c in Counter(body).values())) if n else 0
    mix = ("d" if digits else "") + ("u" if upper else "") + ("l" if lower else "") + ("s" if n > digits + upper + lower else "")
    length, changes = min(10, n // 4), min(9, 10 * turns // max(n, 1))
    out = [
        "bias", f"mix:{mix}", f"len:{length}", f"mix+len:{mix}{length}", f"turns:{changes}", f"mix+turns:{mix}{changes}",
        f"entropy:{entropy}", f"digits:{10 * digits // max(n, 1)}", f"mix+entropy:{mix}{entropy}",
        f"dots:{min(4, body.count('.'))}", f"slashes:{min(4, body.count('/'))}", f"dashes:{min(5, body.count('-'))}", f"equals:{min(2, len(token) - len(token.rstrip('=')))}",
    ]
    if re.fullmatch(r"[0-9a-f]+", body) and digits:
        out.append(f"hex:{length}")
    if m := re.match(r"([A-Za-z]{2,8})[-_]", body):
        out.append(f"prefix:{m[1].lower()}")
    if re.match(r"(?:AKIA|eyJ|AIza|gh[pous]_|xox[bp]-|sk[-_])", body):
        out.append("known")
    if re.fullmatch(r"[\d./-]+", body):
        out.append("number")
    return [*out, f"ascii:{body.isascii()}"]


def plain(token: str, known: Collection[str]) -> tuple | None:
    """What decides the features of a plain word that is not among the known ones; None for any other token."""
    body = token.rstrip("=.-")
    case = _case(body)
    if not case or body.lower()[:20] in known:
        return None
    return case, min(10, len(body) // 4), body.isascii(), min(2, len(token) - len(token.rstrip("="))), token.endswith("=")


def _word(token: str) -> str:
    """What a token is to its neighbours: its last word, or its kind."""
    body = token.rstrip("=.-").lower()
    found = body if body.isalpha() else re.search(r"[^\W\d]*$", body)[0]
    return found[:20] or ("#" if body else "-")


def neighbour_features(token: str) -> tuple[list[str], list[str], list[str]]:
    """Features that a token gives the next one, the one after that, and the one before."""
    w, ends = _word(token), "=" if token.endswith("=") else ""
    return [f"before1:{w}", f"ends:{ends}", f"before1:{w}{ends}"], [f"before2:{w}"], [f"after:{w}"]


def sign_features(signs: str) -> tuple[list[str], list[str]]:
    """Features that the characters between two tokens give the one after and the one before."""
    near = "".join(sorted({c for c in signs[-4:] if c in "=:\"'@#(<\n,;"}))
    return [f"gap:{near}"], [f"end:{signs[:1]}"]


def split(text: str) -> tuple[list[str], list[str]]:
    """(signs, tokens): signs before each token, and after the last."""
    parts = TOKEN.split(text)
    return parts[0::2], parts[1::2]


def token_features(text: str) -> list[list[str]]:
    """All features of each token of a text, as the field is trained on them."""
    signs, tokens = split(text)
    whole = file_features(text)
    out = []
    for i, token in enumerate(tokens):
        one = shape_features(token) + whole + sign_features(signs[i])[0] + sign_features(signs[i + 1])[1]
        one += neighbour_features(tokens[i - 1] if i else "")[0] + neighbour_features(tokens[i - 2] if i > 1 else "")[1]
        out.append(one + neighbour_features(tokens[i + 1] if i + 1 < len(tokens) else "")[2])
    return out


# ---- the field ---------------------------------------------------------------------------------------------------

B, I, O = range(3)  # noqa: E741
NEVER = -1e9


class _Kept(dict):
    """Rows of a table of contributions, by token or signs.

    contribute gives the lists of features of a key; keys for which alike is equal (and not None) share a row.
    """

    def __init__(self, weight: dict[str, np.ndarray], contribute: Callable[[str], Sequence[list[str]]], alike: Callable[[str], tuple | None] = lambda key: None) -> None:
        super().__init__()
        self.weight, self.contribute, self.alike, self.shared, self.size = weight, contribute, alike, {}, 0
        self.table = np.zeros((1024, len(contribute("")), 3))

    def __missing__(self, key: str) -> int:
        same = self.alike(key)
        place = self.shared.get(same) if same is not None else None
        if place is None:
            if self.size == len(self.table):
                self.table = np.concatenate((self.table, np.zeros_like(self.table)))
            place, self.size = self.size, self.size + 1
            for row, features in zip(self.table[place], self.contribute(key), strict=True):
                for f in features:
                    if f in self.weight:
                        row += self.weight[f]
            if same is not None:
                self.shared[same] = place
        self[key] = place
        return place

    def gather(self, keys: Sequence[str]) -> np.ndarray:
        """Contributions by key and list of features."""
        at = np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))
        return self.table[at]


class Field:
    """Weights by feature and tag, and by pair of tags; chains begin and end beside an O."""

    def __init__(self) -> None:
        self.weight: dict[str, np.ndarray] = {}
        self.step = np.zeros((3, 3))
        self.step[O, I] = NEVER
        self._tokens = self._signs = None

    def __getstate__(self) -> tuple:
        return self.weight, self.step

    def __setstate__(self, state: tuple) -> None:
        self.weight, self.step = state
        self._tokens = self._signs = None

    def emissions(self, text: str) -> tuple[list[str], list[str], np.ndarray]:
        """(signs, tokens, scores by token and tag) of a text."""
        if self._tokens is None or len(self._tokens) > KEPT or len(self._signs) > KEPT:
            known = {f.split(":", 1)[1].rstrip("=") for f in self.weight if f.startswith(("word:", "before", "after:"))}
            self._tokens = _Kept(self.weight, lambda t: (shape_features(t), *neighbour_features(t)), lambda t: plain(t, known))
            self._signs = _Kept(self.weight, sign_features)
        signs, tokens = split(text)
        if not tokens:
            return signs, tokens, np.zeros((0, 3))
        each, between = self._tokens.gather(["", *tokens, ""]), self._signs.gather(signs)
        out = each[1:-1, 0] + each[:-2, 1] + each[2:, 3] + between[:-1, 0] + between[1:, 1]
        out += np.concatenate((each[:1, 2], each[:-3, 2]))
        return signs, tokens, out + sum((self.weight[f] for f in file_features(text) if f in self.weight), np.zeros(3))

    def certain(self, e: np.ndarray) -> np.ndarray:
        """Whether a token is O on every best path.

        Take a path with tag x at the token. With O in its place, and B for an I that follows, it stays allowed and gains O's
        lead over x, less the most that the steps beside the token can lose and less what B lacks to I at the next token.
        """
        s, tags = self.step, (B, I, O)
        ok = lambda *pairs: all(s[p] > NEVER / 2 for p in pairs)
        plain = max(s[p, x] + s[x, q] - s[p, O] - s[O, q] for p in tags for x in (B, I) for q in (B, O) if ok((p, x), (x, q)))
        inside = max(s[p, x] + s[x, I] + s[I, r] - s[p, O] - s[O, B] - s[B, r] for p in tags for x in (B, I) for r in tags if ok((p, x), (x, I), (I, r)))
        lacks = np.maximum(0, np.append(e[1:, I] - e[1:, B], 0))
        return e[:, O] - np.maximum(e[:, B], e[:, I]) > np.maximum(plain, inside + lacks) + 1e-9

    def decode(self, e: np.ndarray) -> list[tuple[int, list[int]]]:
        """(first token, tags) of the pieces of the best path between tokens that are certainly O."""
        open_ = np.flatnonzero(~self.certain(e))
        if not len(open_):
            return []
        return [(int(run[0]), self.viterbi(e[run[0] : run[-1] + 1])) for run in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1)]

    def viterbi(self, e: np.ndarray) -> list[int]:
        best, back = e[0] + self.step[O], []
        for row in e[1:]:
            both = best[:, None] + self.step
            back.append(both.argmax(0))
            best = both.max(0) + row
        tags = [int((best + self.step[:, O]).argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def fit(self, data: list[tuple[list[list[str]], list[int]]], rounds: int = 8, together: int = 50, rate: float = 0.25, decay: float = 1e-4) -> Field:
        """Stochastic gradient ascent (steps scaled by past gradients) on the chains' likelihood, several chains at a time.

        Features of fewer than three tokens are left out.
        """
        seen_in = Counter(f for features, _ in data for fs in features for f in fs)
        names = {f: k for k, f in enumerate(f for f, n in seen_in.items() if n > 2)}
        rows = [[[names[f] for f in fs if f in names] for fs in features] for features, _ in data]
        wide = max(len(fs) for features in rows for fs in features)
        w, seen = np.zeros((len(names) + 1, 3)), np.full((len(names) + 1, 3), 1e-8)  # the last row is for padding
        step, step_seen = np.zeros((3, 3)), np.full((3, 3), 1e-8)
        step[O, I] = NEVER
        for k in range(rounds):
            for at in range(0, len(rows), together):
                part, want = rows[at : at + together], [tags for _, tags in data[at : at + together]]
                longest = max(map(len, part))
                f = np.full((len(part), longest, wide), len(names))
                gold = np.full((len(part), longest), O)
                for i, features in enumerate(part):
                    gold[i, : len(features)] = want[i]
                    for j, fs in enumerate(features):
                        f[i, j, : len(fs)] = fs
                inside = np.arange(longest) < np.array([[len(x)] for x in part])
                e = w[f].sum(2)
                e[~inside] = [NEVER, NEVER, 0]  # padding is O
                tags, pairs = _expected(e, step)
                true = np.zeros((3, 3))
                ends = np.concatenate((np.full((len(part), 1), O), gold, np.full((len(part), 1), O)), 1)
                np.add.at(true, (ends[:, :-1], ends[:, 1:]), 1)
                gain = (np.eye(3)[gold] - tags) * inside[:, :, None]
                change = np.zeros_like(w)
                np.add.at(change, f.reshape(-1), np.repeat(gain.reshape(-1, 3), wide, 0))
                change = change / len(part) - decay * w
                seen += change * change
                w += rate / (1 + 0.3 * k) * change / np.sqrt(seen)
                w[-1] = 0
                change = (true - pairs) / len(part)
                step_seen += change * change
                step += rate / (1 + 0.3 * k) * change / np.sqrt(step_seen)
                step[O, I] = NEVER
        self.weight, self.step = {name: w[i] for name, i in names.items()}, step
        return self


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def _expected(e: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected tags and the sum of expected tag pairs of chains (chain, token, tag), by forward and backward sums."""
    n = e.shape[1]
    a, z = np.zeros_like(e), np.zeros_like(e)
    a[:, 0] = e[:, 0] + step[O]
    for i in range(1, n):
        a[:, i] = e[:, i] + _log_sum(a[:, i - 1, :, None] + step, 1)
    z[:, -1] = step[:, O]
    for i in range(n - 2, -1, -1):
        z[:, i] = _log_sum(step + (e[:, i + 1] + z[:, i + 1])[:, None, :], 2)
    total = _log_sum(a[:, -1] + z[:, -1], 1)[:, None, None]
    tags = np.exp(a + z - total)
    pairs = np.zeros((3, 3))
    pairs[O] += tags[:, 0].sum(0)
    pairs[:, O] += tags[:, -1].sum(0)
    if n > 1:
        pairs += np.exp(a[:, :-1, :, None] + step + (e[:, 1:] + z[:, 1:])[:, :, None, :] - total[..., None]).sum((0, 1))
    return tags, pairs


# ---- training lines ----------------------------------------------------------------------------------------------


def _pick(r: random.Random, alphabet: str, n: int) -> str:
    """n characters, a digit among them."""
    out = [r.choice(alphabet) for _ in range(n)]
    out[r.randrange(n)] = r.choice(string.digits)
    return "".join(out)


def _secret(r: random.Random) -> list[str]:
    """The tokens of one secret."""
    mixed, hexa = string.ascii_letters + string.digits, "0123456789abcdef"
    return r.choice(
        [
            lambda: [_pick(r, hexa, r.choice([32, 40, 48, 64]))],
            lambda: [_pick(r, hexa, r.choice([32, 40, 64]))],
            lambda: [_pick(r, mixed, r.randint(20, 48))],
            lambda: [_pick(r, mixed + "+/", r.randint(24, 60)) + "=" * r.randint(0, 2)],
            lambda: ["AKIA" + _pick(r, string.ascii_uppercase + string.digits, 16)],
            lambda: [r.choice(["ghp_", "sk_live_", "sk-", "pk_", "xoxb-", "AIza", "glpat-", "key-"]) + _pick(r, mixed, r.randint(20, 40))],
            lambda: [f"eyJ{_pick(r, mixed, 20)}.eyJ{_pick(r, mixed, 40)}.{_pick(r, mixed + '_-', 30)}"],
            lambda: [_pick(r, mixed + "_", r.randint(6, 18))],
            lambda: [_plain_word(r) + _pick(r, string.digits, r.randint(2, 5))],
            lambda: [_pick(r, mixed + "+/", 40) for _ in range(r.randint(2, 5))],
        ]
    )()


def _plain(r: random.Random) -> str:
    """Something that has digits but is no secret."""
    digits = lambda n: "".join(r.choice(string.digits) for _ in range(n))
    return r.choice(
        [
            lambda: digits(r.randint(1, 20)),
            lambda: digits(16),
            lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}",
            lambda: f"{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}",
            lambda: f"{_plain_word(r)}.{r.randint(1, 99)}@mail{r.randint(1, 9)}.example.com",
            lambda: f"+{r.randint(1, 99)} {r.randint(100, 999)} {digits(7)}",
            lambda: f"/{_plain_word(r)}/{_plain_word(r)}{r.randint(0, 99)}/{_plain_word(r)}.{r.choice(['html', 'py', 'png'])}",
            lambda: f"{_plain_word(r)}-{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}",
            lambda: f"{r.randint(100, 999)}-{r.randint(1000, 9999)}",
            lambda: f"{r.randint(1, 999999)}.{r.randint(10000, 99999)}",
            lambda: f"{_plain_word(r)}_{_plain_word(r)}_{r.randint(0, 99)}",
            lambda: f"{_plain_word(r).upper()}{r.randint(100, 9999)}-{r.randint(10, 99)}",
            lambda: f"{_plain_word(r)}{_plain_word(r)}{r.randint(0, 999)}",
            lambda: f"https://www.{_plain_word(r)}{r.randint(0, 9)}.com/{_plain_word(r)}",
            lambda: r.choice(["the password must be changed", "a secret of", "his token: a sign", "no password is needed", "secret - " + _plain_word(r), "every token has " + digits(2), f"password = {r.choice(['none', 'None', 'null', 'required', '****'])}"]),
        ]
    )()


#: Syllables of made-up prose; some of other alphabets.
SYLLABLES = "an the er on re ti es la men to in de ou ver sch al co mi ció ñ é ü ß au que os ung und".split()


def _plain_word(r: random.Random) -> str:
    return "".join(r.choice(SYLLABLES[:18]) for _ in range(r.randint(1, 4)))


def _prose(r: random.Random, most: int) -> str:
    words = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 5))) for _ in range(r.randint(0, most))]
    words = [w.capitalize() if r.random() < 0.1 else w.upper() if r.random() < 0.02 else w for w in words]
    return " ".join(w + r.choice([",", ".", ":", ";", "!", ")", '"']) if r.random() < 0.12 else w for w in words)


def training_lines(count: int = 2500, seed: int = 7) -> Iterator[tuple[str, list[tuple[int, int, bool]]]]:
    """(text, (start, end, whether it begins a secret) of each token of its secrets) of generated lines."""
    r = random.Random(seed)
    names = ["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "auth", "credential", "access_key", "private_key", "bearer", "client_secret", "signature"]
    for _ in range(count):
        text, spans = _prose(r, 10), []
        for _ in range(r.randint(1, 3)):
            text += r.choice([" ", " ", "\n"])
            if r.random() < 0.45:
                tokens = _secret(r)
                short = len(tokens) == 1 and len(tokens[0]) < 20
                if short or r.random() < 0.75:
                    name = r.choice(names)
                    text += (name.upper() if r.random() < 0.2 else name) + r.choice([" = ", "=", ": ", ":", ' = "', "='", '": "', " = "])
                first = True
                for token in tokens:
                    text += "" if first else "\n"
                    spans.append((len(text), len(text) + len(token), first))
                    text += token
                    first = False
                text += r.choice(["", '"', "'", ";", "", ","])
            else:
                if r.random() < 0.3:
                    text += r.choice(["id", "version", "date", "order", "phone", "commit", "file", "at", "host", "number"]) + r.choice([" ", ": ", " = "])
                text += _plain(r)
            text += " " + _prose(r, 10)
        yield text, spans


@functools.lru_cache(1)
def trained() -> Field:
    """The field fitted to the generated lines, once in a process."""
    data = []
    for text, spans in training_lines():
        signs, tokens = split(text)
        begins = {s: (B if first else I) for s, _, first in spans}
        tags = [begins.get(s, O) for s, _ in places(signs, tokens)]
        if tags:
            data.append((token_features(text), [B if t == I and (k == 0 or tags[k - 1] == O) else t for k, t in enumerate(tags)]))
    return Field().fit(data)


def places(signs: list[str], tokens: list[str]) -> list[tuple[int, int]]:
    """(start, end) of each token in its text."""
    out, at = [], 0
    for sign, token in zip(signs, tokens, strict=False):
        out.append((at + len(sign), at + len(sign) + len(token)))
        at = out[-1][1]
    return out


def field_spans(text: str, field: Field) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the secrets that the field finds, in order, without signs at their ends."""
    signs, tokens, e = field.emissions(text)
    pieces = [(first, tags) for first, tags in field.decode(e) if B in tags]
    if not pieces:
        return []
    ends = np.cumsum([len(s) + len(t) for s, t in zip(signs, tokens, strict=False)])
    out: list[list[int]] = []
    for first, tags in pieces:
        for i, tag in enumerate(tags, first):
            end = int(ends[i])
            if tag == B:
                out.append([end - len(tokens[i]), 3, 0])
            if tag != O:
                out[-1][2] = end - len(tokens[i]) + len(tokens[i].rstrip(".-"))
    return [tuple(x) for x in out if x[2] > x[0]]


def all_spans(text: str, field: Field) -> list[tuple[int, int, int]]:
    """Base spans and the field's, which may lie within one another."""
    return sorted(base_spans(text) + field_spans(text, field))


def scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) of every row of docs (doc_id, text), in code points, by start and kind.

    The field's spans are listed beside the base ones, also where they lie within them. A null or empty text has no spans; repeated rows get equal results; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field or trained())  # some thousand weights, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in all_spans(t, shared.value)] for t in common.strings(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return common.map_batches(docs.select("doc_id", "text"), run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs with every span replaced by MASK, overlapping ones as one; n_chars, if there, follows the new text."""
    shared = docs.sparkSession.sparkContext.broadcast(field or trained())
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, changed = batch.column(at).to_pylist(), {}
            for row, text in enumerate(texts):
                spans = all_spans(text, shared.value) if text else []
                if spans:
                    parts, last = [], 0
                    for s, _, e in spans:
                        if s >= last:
                            parts += [text[last:s], MASK]
                        last = max(last, e)
                    texts[row] = changed[row] = "".join([*parts, text[last:]])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            if size is not None and changed:
                columns[size] = pa.array([len(changed[row]) if row in changed else n for row, n in enumerate(columns[size].to_pylist())], columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, names=docs_columns)

    docs_columns = docs.columns
    return common.map_batches(docs, run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda kind: F.expr(f"CAST(size(filter(spans, s -> s.kind = '{kind}')) AS BIGINT)").alias(f"n_{kind}")
    listed = lambda spans: f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    return scan(common.table(spark, sf_dir, "documents")).select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(F.expr(listed("filter(spans, s -> s.kind <> 'crf')")), 256).alias("base_sha256"),
        F.expr(listed("spans")).alias("spans"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents, their secrets masked."""
    return redact(docs)
