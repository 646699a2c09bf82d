"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes that adds to them.

The field is trained by maximum likelihood (forward-backward, Adam) from a small labelled table on the driver and
sent out with the code: its size depends on the labelled table only.  It reads every token of every text.  Scores of distinct
tokens are made once and gathered by number.  Most tokens are O beyond doubt: no run of other tags through them could gain what
they cost, whatever stands around (``doubtful``).  Viterbi, in numpy, decodes the runs of tokens between those, many at a
time; the result is that of decoding whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm import _common as c
from gridloom.llm.substring_dedup import words_and_places

#: Kinds in the order in which equal starts are listed.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Bytes of text that are decoded together.
DECODE_BYTES = 1 << 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT, _DIGITS, _LETTERS, _SAME = re.compile("[0-9]"), re.compile("[0-9]+"), re.compile(r"[^\W\d_]+"), re.compile(r"(.)\1+", re.DOTALL)
_CODE, _DASHED, _DOTTED = re.compile("[A-Za-z0-9_]+"), re.compile(r"[0-9]+(-[0-9]+)+"), re.compile(r"[0-9]+(\.[0-9]+)+")
_SPECIAL = np.zeros(256, bool)
_SPECIAL[[ord(x) for x in "0123456789@+"]] = True
_EDGE = ".,;:!?\"'()[]{}<>#$%&*|"

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _is_card(text: str) -> bool:
    digits = re.sub("[^0-9]", "", text)
    return 12 <= len(digits) <= 19 and luhn(digits)


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the fixed patterns, in code points, by start and kind.

    Each kind by itself: leftmost matches that don't overlap; a match that fails its test is dropped.  Time is linear
    in the text's length: the part of an address before @ is read backwards from each @.
    """
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((a, m.end(), "email"))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))
    out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37:
            digits = re.sub(r"[\x20-]", "", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def listed(spans: Iterable[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def shape(token: str) -> str:
    """The token with runs of capitals, of other letters and of digits as A, a and 9; tokens of more than 24 such runs are ~."""
    s = _DIGITS.sub("9", token.strip(_EDGE) or token[:1])
    s = _LETTERS.sub(lambda m: "".join("A" if upper else "a" for upper, _ in groupby(m[0], str.isupper)), s)
    s = _SAME.sub(r"\1", s)
    return s if len(s) <= 24 else "~"


def features(token: str) -> list[str]:
    """Word-shape features of one token."""
    core = token.strip(_EDGE)
    if core.isalpha() and (core.islower() or core.isupper()):  # most tokens: what follows would give the same
        size = min(len(core), 40)
        return [f"s:{'a' if core.islower() else 'A'}", "d:0", f"l:{size if size < 6 else size // 4 * 4 + 100}", *(["round"] if token[:1] == "(" and token[-1:] == ")" else [])]
    digits = len(_DIGIT.findall(core))
    size = min(len(core), 40)
    out = [f"s:{shape(token)}", f"d:{min(digits, 20) if digits < 4 or digits > 8 else 'mid'}", f"l:{size if size < 6 else size // 4 * 4 + 100}"]
    if "@" in core:
        out.append("at")
    if core[:1] == "+":
        out.append("plus")
    if token[:1] == "(" and token[-1:] == ")":
        out.append("round")
    if size >= 16 and digits >= 3 and digits < len(core) and _CODE.fullmatch(core):
        out.append("code")
    if _DASHED.fullmatch(core):
        out.append("dashed:" + ("-".join(str(min(len(x), 6)) for x in core.split("-")) if core.count("-") < 4 else "many"))
    if _DOTTED.fullmatch(core):
        out.append(f"dotted:{min(core.count('.'), 9)}")
    return out


def labelled_table(n: int = 500, seed: int = 7) -> list[tuple[list[str], list[str]]]:
    """A small labelled table made by rule: (tokens, tags) of short stretches with and without personal data."""
    rng = np.random.default_rng(seed)

    def digits(k):
        return "".join(map(str, rng.integers(0, 10, k)))

    def word():
        w = "".join(rng.choice(list("abcdefghilmnoprstu"), rng.integers(1, 9)))
        return w.capitalize() if rng.random() < 0.15 else w

    def plain_word():
        """Words of any length and case."""
        w = word() + (word() + word() * (rng.random() < 0.3) if rng.random() < 0.15 else "")
        return w.upper() if rng.random() < 0.1 else w

    def pick(*options):
        return options[rng.integers(len(options))]

    def number():
        return str(rng.integers(0, 256))

    def hexes(k):
        return "".join(rng.choice(list("0123456789abcdef"), k))

    kinds = {
        "email": lambda: [pick(f"{word()}.{digits(2)}@mail{digits(1)}.{word()}.com", f"{word()}@{word()}.org", f"{word()}_{word()}@{word()}", f"{word()}@[{word()}.net]", f"mailto:{word()}@{word()}.de")],
        "ip": lambda: [pick(".".join(number() for _ in range(4)), ".".join(number() for _ in range(4)) + f":{rng.integers(80, 9000)}", ".".join(number() for _ in range(4)) + "/24", f"2001:db8:{hexes(4)}::{hexes(2)}")],
        "card": lambda: pick([digits(16)], [digits(16)], [digits(4) for _ in range(4)], ["-".join(digits(4) for _ in range(4))]),
        "phone": lambda: pick(["+1", f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"{digits(3)}-{digits(3)}-{digits(4)}"], ["+49", digits(3), digits(7)], [f"+{digits(11)}"]),
        "secret": lambda: [pick(f'"{hexes(40)}"', f'"{hexes(32)}"', hexes(40), f"sk_{hexes(24)}")],
    }
    plain = [
        lambda: [str(rng.integers(1900, 2030))], lambda: [f"{rng.integers(0, 9)}.{rng.integers(0, 9)}."], lambda: ["version", f"{rng.integers(1, 9)}."], lambda: [f"{rng.integers(1, 99)}.{digits(2)}"],
        lambda: [f"20{digits(2)}-0{rng.integers(1, 9)}-{rng.integers(10, 28)}"], lambda: [f"{rng.integers(1, 12)}/{rng.integers(1, 28)}/20{digits(2)}"], lambda: [f"{rng.integers(10, 24)}:{rng.integers(10, 59)}"], lambda: [f"({rng.integers(1, 30)})"],
        lambda: [f"{rng.integers(1, 999)},{digits(3)}"], lambda: [f"{rng.integers(1, 100)}%"], lambda: [f"{word()}{rng.integers(1, 99)}"], lambda: [f"{rng.integers(1, 9)}.{rng.integers(0, 9)}.{rng.integers(0, 20)}"],
        lambda: ["+"], lambda: ["@"], lambda: [f"@{word()}"], lambda: [f"+{rng.integers(1, 9)}"], lambda: [digits(int(rng.integers(1, 9)))], lambda: [f"{rng.integers(1, 90)}-{rng.integers(90, 200)}"], lambda: [f"CC-{word()}-{rng.integers(1, 5)}.0"],
    ]
    out = []
    for _ in range(n):
        tokens, tags = [], []
        for _ in range(rng.integers(1, 4)):
            for _ in range(rng.integers(0, 4)):
                tokens.append(plain_word() + pick("", "", "", ".", ",", "###", "!!"))
                tags.append("O")
            if rng.random() < 0.5:
                kind = KINDS[rng.integers(len(KINDS))]
                if kind == "secret" and rng.random() < 0.7:
                    tokens += ["token", "="]
                    tags += ["O", "O"]
                own = kinds[kind]()
                own[-1] += pick("", "", "", ".", ",", "###", "!!")
                tokens += own
                tags += [f"{'I' if i else 'B'}-{kind}" for i in range(len(own))]
            else:
                own = plain[rng.integers(len(plain))]()
                tokens += own
                tags += ["O"] * len(own)
        for _ in range(rng.integers(1, 4)):
            tokens.append(plain_word())
            tags.append("O")
        out.append((tokens, tags))
    return out


class Field:
    """A linear-chain conditional random field over the shape features of a token and of its two neighbours."""

    def __init__(self, tags: tuple[str, ...] = TAGS):
        self.tags, self.index = tags, {}
        k = len(tags)
        # I-x only follows B-x or I-x: a rule, not a weight
        self.ban = np.zeros((k + 1, k))
        for j, t in enumerate(tags):
            if t[0] == "I":
                for i in range(k + 1):
                    if i == k or tags[i][1:] != t[1:]:
                        self.ban[i, j] = -1e4
        self.known: dict[int, int] = {}  # from the hash of a token to its row of scores, which tokens of equal features share
        self.rows: dict[tuple[str, ...], int] = {}
        self.scores = np.zeros((0, 3, len(tags)))

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "rows": {}, "scores": self.scores[:0]}

    def _names(self, tokens: list[str], i: int) -> list[str]:
        out = ["c:" + f for f in features(tokens[i])]
        out += ["p:" + f for f in features(tokens[i - 1])] if i else ["p:^"]
        return out + (["n:" + f for f in features(tokens[i + 1])] if i + 1 < len(tokens) else ["n:$"])

    def train(self, table: list[tuple[list[str], list[str]]], epochs: int = 40, rate: float = 0.2, decay: float = 2e-3) -> Field:
        k, where = len(self.tags), {t: i for i, t in enumerate(self.tags)}
        rows = [[[self.index.setdefault(f, len(self.index)) for f in self._names(w, i)] for i in range(len(w))] for w, _ in table]
        n, longest, most = len(table), max(len(w) for w, _ in table), max(len(f) for r in rows for f in r)
        feats = np.full((n, longest, most), len(self.index))
        gold, length = np.zeros((n, longest), int), np.array([len(w) for w, _ in table])
        for s, (r, (_, tags)) in enumerate(zip(rows, table, strict=True)):
            for i, f in enumerate(r):
                feats[s, i, : len(f)] = f
                gold[s, i] = where[tags[i]]
        mask = np.arange(longest)[None, :] < length[:, None]
        weight, step = np.zeros((len(self.index) + 1, k)), np.zeros((k + 1, k))
        moments = [np.zeros_like(x) for x in (weight, weight, step, step)]
        each = np.arange(n)
        for epoch in range(1, epochs + 1):
            emit = weight[feats].sum(axis=2)
            trans = step + self.ban
            alpha, beta = np.zeros((n, longest, k)), np.zeros((n, longest, k))
            alpha[:, 0] = trans[k] + emit[:, 0]
            for t in range(1, longest):
                new = _logsum(alpha[:, t - 1, :, None] + trans[None, :k], 1) + emit[:, t]
                alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
            total = _logsum(alpha[:, -1], 1)
            pairs = np.zeros((k + 1, k))
            for t in range(longest - 1, 0, -1):
                inner = emit[:, t] + beta[:, t]
                joint = np.exp(alpha[:, t - 1, :, None] + trans[None, :k] + inner[:, None, :] - total[:, None, None])
                pairs[:k] += (joint * mask[:, t, None, None]).sum(axis=0)
                beta[:, t - 1] = np.where(mask[:, t, None], _logsum(trans[None, :k] + inner[:, None, :], 2), beta[:, t])
            node = np.exp(alpha + beta - total[:, None, None]) * mask[:, :, None]
            pairs[k] = node[:, 0].sum(axis=0)
            node *= -1
            node[each[:, None], np.arange(longest)[None, :], gold] += mask
            pairs *= -1
            np.add.at(pairs, (np.full(n, k), gold[:, 0]), 1)
            np.add.at(pairs, (gold[:, :-1][mask[:, 1:]], gold[:, 1:][mask[:, 1:]]), 1)
            grad = np.zeros_like(weight)
            np.add.at(grad, feats.reshape(-1, most), node.reshape(-1, 1, k).repeat(most, 1))
            grad[-1] = 0
            for x, g, m, v in ((weight, grad / n - decay * weight, *moments[:2]), (step, pairs / n - decay * step, *moments[2:])):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x += rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)
            weight[-1] = 0
        self.weight, self.trans = weight[:-1], step + self.ban
        return self

    def of(self, found: tuple[str, ...]) -> np.ndarray:
        """What a token of these features scores as the one itself, as the one before and as the one after, for each tag."""
        return np.stack([self.weight[[self.index[f"{side}:{f}"] for f in found if f"{side}:{f}" in self.index]].sum(axis=0) for side in "cpn"])

    def edge(self, name: str) -> np.ndarray:
        return self.weight[self.index[name]] if name in self.index else np.zeros(len(self.tags))

    def emissions(self, words: np.ndarray, token_of, starts: np.ndarray) -> np.ndarray:
        """The score of each tag for each token of some texts; words: a hash of each token, token_of(i): the token, starts: the first of each text."""
        distinct, first, which = np.unique(words, return_index=True, return_inverse=True)
        if len(self.known) > 200_000 or len(self.rows) > 20_000:
            self.known, self.rows, self.scores = {}, {}, self.scores[:0]
        place = np.array([self.known.get(h, -1) for h in distinct.tolist()], np.int64)
        new, made = np.flatnonzero(place < 0), []
        for i, j, h in zip(new.tolist(), first[new].tolist(), distinct[new].tolist(), strict=True):
            found = tuple(features(token_of(j)))
            if found not in self.rows:
                self.rows[found] = len(self.rows)
                made.append(self.of(found))
            self.known[h] = place[i] = self.rows[found]
        if made:
            self.scores = np.concatenate([self.scores, np.stack(made)])
        at = place[which]
        out = self.scores[at, 0]
        edge = np.zeros(len(words) + 1, bool)
        edge[starts], edge[-1] = True, True
        before, after = np.flatnonzero(~edge[:-1]), np.flatnonzero(~edge[1:])
        out[before] += self.scores[at[before - 1], 1]
        out[after] += self.scores[at[after + 1], 2]
        out[edge[:-1]] += self.edge("p:^")
        out[edge[1:]] += self.edge("n:$")
        return out

    def doubtful(self, emit: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Which tokens might not be O in the likeliest tags.

        Take a run of tokens that aren't O and make them O.  That changes the score by at most the sum over the run of what
        each token's best other tag and the step to it score more than O, and a constant.  If no run through a token can
        reach 0, its tag is O.  The best runs that end before it and begin after it are found by running sums.
        """
        step, k = self.trans, len(self.tags)
        inner = step[1:k, 1:].max() - step[0, 0]
        enter = max((step[a, 1:] - step[a, 0]).max() for a in (0, k))
        gain = emit[:, 1:].max(axis=1) - emit[:, 0] + inner
        constant = enter - inner + max((step[1:k, 0] - step[0, 0]).max(), 0.0)
        # between texts stands a token that no run can pass
        at = np.arange(len(gain)) + np.searchsorted(starts, np.arange(len(gain)), side="right")
        line = np.full(len(gain) + len(starts) + 1, -1.0 - np.maximum(gain, 0).sum())
        line[at] = gain

        def best_to(x: np.ndarray) -> np.ndarray:
            total = np.cumsum(x)
            return total - np.minimum.accumulate(np.minimum(total, 0))

        left, right = best_to(line), best_to(line[::-1])[::-1]
        return gain + left[at - 1] + right[at + 1] + constant > -1e-6

    def decode(self, emit: np.ndarray, starts: np.ndarray, sure: bool = True) -> np.ndarray:
        """The likeliest tags (numbers) of the tokens of some texts (Viterbi, many runs of tokens at a time); ``sure`` leaves out what is O beyond doubt."""
        n, k = len(emit), len(self.tags)
        tags = np.zeros(n, np.int8)
        open_ = self.doubtful(emit, starts) if sure else np.ones(n, bool)
        head = np.zeros(n, bool)
        head[starts[starts < n]] = True
        begin = np.flatnonzero(open_ & (head | ~np.r_[False, open_[:-1]]))
        end = np.flatnonzero(open_ & np.r_[head[1:] | ~open_[1:], True]) + 1 if n else begin
        size = end - begin
        by = np.argsort(size, kind="stable")
        at = 0
        while at < len(by):
            limit = max(1, min(50_000 // int(size[by[at]]), int(np.searchsorted(size[by], 2 * size[by[at]] + 8, side="right")) - at))
            own = by[at : at + limit]
            at += len(own)
            length, longest = size[own], int(size[own[-1]])
            place = np.minimum(begin[own][:, None] + np.arange(longest)[None, :], n - 1)
            back = np.zeros((len(own), longest, k), np.int8)
            best = np.where(head[begin[own]][:, None], self.trans[k], self.trans[0]) + emit[begin[own]]
            for t in range(1, longest):
                step = best[:, :, None] + self.trans[None, :k]
                live = (t < length)[:, None]
                back[:, t] = np.where(live, step.argmax(axis=1), np.arange(k))
                best = np.where(live, step.max(axis=1) + emit[place[:, t]], best)
            closed = (end[own] < n) & ~head[np.minimum(end[own], n - 1)]  # O stands after it
            last = (best + np.where(closed[:, None], self.trans[:k, 0], 0.0)).argmax(axis=1)
            for t in range(longest - 1, -1, -1):
                live = t < length
                tags[place[live, t]] = last[live]
                last = back[np.arange(len(own)), t, last]
        return tags


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def span_of(a: int, b: int, kind: str, text: str) -> list[Span]:
    """The span that tags describe, without punctuation at either end, if anything is left; numbers that fail the card checksum are no cards."""
    whole = text[a:b]
    left, right = len(whole) - len(whole.lstrip(_EDGE)), len(whole) - len(whole.rstrip(_EDGE))
    if left and whole[left - 1] == "(" and ")" in whole[left:]:
        left -= 1
    if left + right >= len(whole) or (kind == "card" and not _is_card(text[a + left : b - right])):
        return []
    return [(a + left, b - right, kind)]


def find_spans(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text: base spans stay, and what the field finds elsewhere is added."""
    bodies = [t.encode() for t in texts]
    offsets = np.r_[0, np.cumsum([len(b) for b in bodies])].astype(np.int64)
    return _spans(offsets, np.frombuffer(b"".join(bodies), np.uint8), field)


def _spans(offsets: np.ndarray, data: np.ndarray, field: Field) -> list[tuple[list[Span], list[Span]]]:
    """find_spans() of texts as bytes."""
    n, raw = len(offsets) - 1, data.tobytes()
    seen = np.r_[0, np.cumsum(_SPECIAL[data])]
    marked = seen[offsets[1:]] > seen[offsets[:-1]]  # base spans have a digit, @ or +
    words, counts, first, last = words_and_places(c.Texts(np.zeros(n, np.int64), offsets, data, np.zeros(n, np.uint32)))
    starts = (np.cumsum(counts) - counts)[counts > 0]
    tags = np.zeros(0, np.int8)
    if len(words):
        emit = field.emissions(words, lambda i: raw[first[i] : last[i]].decode(), starts)
        tags = field.decode(emit, starts)
    doc = np.repeat(np.arange(n), counts)
    names = field.tags
    begins = np.flatnonzero(np.array([t[0] == "B" for t in names])[tags]) if len(tags) else np.zeros(0, int)
    found: dict[int, list[int]] = {}
    for i in begins.tolist():
        found.setdefault(int(doc[i]), []).append(i)
    edges = np.r_[0, np.cumsum(counts)]
    out = []
    for d in range(n):
        if not marked[d] and d not in found:
            out.append(([], []))
            continue
        body = raw[offsets[d] : offsets[d + 1]]
        text = body.decode()
        base = base_spans(text) if marked[d] else []
        more: list[Span] = []
        if d in found:
            # code points before each byte
            points = np.r_[0, np.cumsum((data[offsets[d] : offsets[d + 1]] & 0xC0) != 0x80)]
            for i in found[d]:
                j = i + 1
                while j < edges[d + 1] and names[tags[j]] == "I" + names[tags[i]][1:]:
                    j += 1
                more += span_of(int(points[first[i] - offsets[d]]), int(points[last[j - 1] - offsets[d]]), names[tags[i]][2:], text)
            more = _apart(more, base)
        out.append((base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))))
    return out


def _apart(spans: list[Span], base: list[Span]) -> list[Span]:
    """Those of ``spans`` that touch no base span."""
    if not base:
        return spans
    starts = np.array([b[0] for b in base])
    reach = np.maximum.accumulate(np.array([b[1] for b in base]))
    out = []
    for s in spans:
        i = int(np.searchsorted(starts, s[1])) - 1
        if i < 0 or reach[i] <= s[0]:
            out.append(s)
    return out


_MODEL: dict[str, Field] = {}


def default_field() -> Field:
    """The field trained from the built-in labelled table; the same in every run."""
    if "field" not in _MODEL:
        _MODEL["field"] = Field().train(labelled_table())
    return _MODEL["field"]


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span as <kind>; spans that overlap merge under the kind of the first."""
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"<{k}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def pii(docs: DataFrame, field: Field | None = None, doc_id: str = "doc_id", text: str = "text", with_text: bool = True, with_row: bool = False) -> DataFrame:
    """Finds personal data: doc_id, n_email, n_ip, n_card, n_phone (base spans), base and spans (``kind:start:end``, comma-joined), redacted (the text with each span as <kind>).

    Offsets are in code points, ends exclusive.  Null texts count as empty and have no spans; long texts count whole.  Repeated
    rows and rows without doc_id are kept; an empty table gives an empty result; other columns are ignored, whatever their names.
    ``with_text`` leaves out redacted if false; ``with_row`` adds the row itself as a struct.
    """
    field = field or default_field()
    kinds = {**{f"n_{k}": pa.int64() for k in BASE_KINDS}, "base": pa.string(), "spans": pa.string(), **({"redacted": pa.string()} if with_text else {})}

    def run(batches):
        for whole in batches:
            sizes, at = np.diff(c.binary_parts(whole.column(1))[0]), 0
            while at < len(whole):
                n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), DECODE_BYTES, side="right")))
                batch = whole.slice(at, n)
                at += n
                cols: dict[str, list] = {k: [] for k in kinds}
                for i, (base, spans) in enumerate(_spans(*c.binary_parts(batch.column(1)), field)):
                    for kind in BASE_KINDS:
                        cols[f"n_{kind}"].append(sum(k == kind for _, _, k in base))
                    cols["base"].append(listed(base))
                    cols["spans"].append(listed(spans))
                    if with_text:
                        text = batch.column(1)[i].as_buffer()
                        text = text.to_pybytes().decode() if text is not None else ""
                        cols["redacted"].append(redact(text, spans) if spans else text)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(cols[k], t) for k, t in kinds.items()), *(batch.column(i) for i in range(2, batch.num_columns))], names=["doc_id", *kinds, *batch.schema.names[2:]])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string" + (", redacted string" if with_text else "")
    row, own = c.whole_row(docs)
    return c.text_rows(docs, text, doc_id, *([row] if with_row else [])).mapInArrow(c.tidy(run), c.schema_of(schema, *([own] if with_row else [])))
