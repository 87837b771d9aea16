"""Personal data: fixed rules for four kinds, and a conditional random field that adds spans.

The field is a linear chain over the white-space tokens of a line, with B/I tags for
each kind. A token is described by its shape (runs of lower case, upper case, digits
and single marks), whole and without the marks at its end, by the first and the last runs
of that, by how many digits, dots, dashes and other marks it has, and by the same counts of the
tokens beside it. It is trained by maximum likelihood from a small labelled table (`LABELLED`, or a DataFrame
of marked texts) on the driver, and decoded by Viterbi for all lines of a batch at once.
A line without a digit, an @ or a written "(at)" holds no span and isn't decoded.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.names import free_name, ref
from .common import map_texts

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
CHUNK = 600_000  # code points decoded together
ROUNDS, RATE, RIDGE = 150, 0.1, 1e-3
SHAPE_RIDGE = 1e-2  # of whole shapes, which say least about other texts

# The labelled table: <kind>…</kind> marks a span.
LABELLED = tuple(
    """
call me at <phone>+1 (555) 010-2345</phone> after six
Tel. <phone>+49 30 901820</phone> oder schreiben Sie
phone: <phone>(555) 010-7788</phone> ask for the office
mobile <phone>(212) 555-0143</phone> or leave a note
appelez le <phone>+33 1 40 20 50 50</phone> le matin
llame al <phone>+34 91 123 45 67</phone> por la tarde
the number <phone>555-010-4477</phone> is not in use
reach us on <phone>(800) 555-0199</phone> , every day
send it to <email>jane.doe@mail.example.com</email> today
write <email>support@example.org</email> or call <phone>+1 (555) 010-9911</phone> now
ecrivez a <email>p.martin7@courrier.example.fr</email> merci
mail an <email>a.34@mail7.example.com</email> und warten
contact <email>first.last+tag@example.co.uk</email> for terms
correo <email>info@ejemplo.example.es</email> para detalles
<email>sales@example.net</email> answers within a day
paid with <card>4111111111111111</card> last week
card <card>4000 1234 5678 9017</card> was declined
Karte <card>5500-0000-0000-0004</card> gesperrt
la tarjeta <card>4012888888881881</card> fue usada
number <card>6011 0009 9013 9424</card> expires soon
from host <ip>192.168.1.17</ip> at noon
server <ip>10.0.0.254</ip> did not answer
Adresse <ip>172.16.31.9</ip> antwortet nicht
the log shows <ip>8.8.4.4</ip> twice
desde <ip>203.0.113.77</ip> se conecto
call <phone>(555) 010-2244</phone>, please
office: <phone>555 010 6612</phone> or come by
Tel <phone>040 55501234</phone> ab neun
Telefon <phone>0221 9876540</phone>, Fax folgt
ring <phone>020 7946 0958</phone> before noon
fax <phone>555.010.3344</phone> until five
text <phone>(303) 555-0188</phone>; then wait
numero <phone>91 123 45 67</phone> por favor
tel: <phone>01 40 20 51 52</phone>.
cell <phone>1-800-555-0134</phone> any time
mail <email>a.b@c.example.net</email>, or not
ask <email>k@mail.example.com</email>.
to <email>first@site.example.org</email>; thanks
(<email>help@desk.example.com</email>)
<<email>team@host.example.net</email>> wrote
write to <email>mary (at) host.example.org</email> today
reach <email>paul [at] mail.example.com</email> now
an <email>info (at) firma.example.de</email>, danke
<email>joe.smith (at) example.com</email> is away
mail <email>anna(at)post.example.org</email> then
<email>mary (at) host.example.org</email>
<email>k.lee (at) mail.example.net</email>
<email>office (at) example.com</email> or by post
contact <email>tom (at) web.example.org</email>
<phone>555 010 3321</phone>
<phone>212 555 0177</phone> is mine
<phone>030 445566</phone>
<phone>(415) 555-0120</phone>
or <phone>303 555 0141</phone>, day and night
host <ip>192.168.7.20</ip>, port 80
from <ip>10.1.2.3</ip>.
ping <ip>172.16.0.9</ip>; it is up
card <card>4111-1111-1111-1111</card>, please
Visa <card>4012 8888 8888 1881</card>.
she (see 4) was (in) the (old) house
look (at) the house and (at) noon
seen at host.example.com and at www.example.org
read www.example.com, or example.org.
page 12 of 300, line 45 and 46
a ratio of 4.5 to 1, about 22.7%
on 12.05.2023 and 03.11.2024 at 8:15
from 1914-1918 and 1939-1945, in all
ISBN 0-306-40615-2, 3rd edition
id 4815162342 and 108, lot 77-12
sum 1,250,000 or 1.250.000 EUR
version 1.2.3 and 10.4.1, build 5521
room 101, floor 3, desk 17
200 300 400 500 and 600
12 34 56 78 90 were drawn
lines 100 200 and 300 400
key = "aK9d-77Xq_0Lm2" and token: 8f3e2a1b
(1999) and (2004), see [12] or [7]
the score was 21-14 and 101-99.
the meeting is on 2024-05-17 at 12:30 in room 4
Version 2.0 of the license, see section 4.2
it costs 12.50 or 1,200 in total, 30% off
born in 1984 and moved in 2001-2003 to the north
pages 10-20 and 35 of volume 3.
see http://www.example.com/en/825?page=2 for more
key = "9f3A0bC4d5E6F7a8b9C0d1E2f3A4b5C6" # keep
order 20231188 shipped on 12/05/2023 by sea
the of and, that is in. The house was old
und der die, das ist. Nicht aber auch
le la les, et de. Que dans pour
el la los, que de. Para con por
a | b | c | 12 | d
WHAT!! NOW!! THE!! END.
of%%% the*** and### to&&& in$$$
isbn 978-3-16-148410-0 in print
5. item five (see 7)
3.14 is near (22/7) they say
x-1 and y-2 (a) (b) [3]
""".strip().split("\n")
)

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin at the first digit of a run and takes the run whole, so the look-behind changes nothing but time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    twice = "0246813579"
    return sum(int(twice[int(d)]) if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by the fixed rules, in order of kind and start."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        # The local part is the run of its characters before the mark, but not inside the last match.
        left = at - (len(run := text[last:at]) - len(run.rstrip(_LOCAL)))
        found = _DOMAIN.match(text, at) if left < at else None
        if found:
            out.append((0, left, found.end()))
        last = found.end() if found else at + 1
        at = text.find("@", last)
    if _DIGITS.search(text):
        out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        out += [(2, *m.span()) for m in _CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


# Character classes: 0 white space, 1 letters without case rule, 2 A-Z, 3 digits, 4 and up single marks, last all other ASCII.
_MARKS = "@.-+()_:/,"
_CLASS = np.full(128, 4 + len(_MARKS), np.int64)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
for _k, _c in enumerate(_MARKS):
    _CLASS[ord(_c)] = 4 + _k
_POWERS = np.array([pow(31, k, 1 << 61) for k in range(12)], np.int64)
_DIGIT_BINS = np.array([1, 2, 4, 6, 8, 10, 12, 14, 16, 17, 20])  # edges of the digit-count classes


FEATURES = 1 << 12  # buckets of the hashed features
_ENDS = np.zeros(5 + len(_MARKS), bool)  # classes cut from the end of a shape: . : , and all other marks
_ENDS[[5, 11, 13, len(_ENDS) - 1]] = True


def _hashed(salt: int, *parts: np.ndarray) -> np.ndarray:
    """Buckets of a feature from small whole numbers."""
    out = np.full(parts[0].shape, salt, np.int64)
    for p in parts:
        out = (out * 1_000_003 + p + 1) & ((1 << 40) - 1)
    return (out ^ (out >> 17)) * 0x9E3779B1 % (1 << 31) % FEATURES


@dataclass
class Tokens:
    start: np.ndarray
    end: np.ndarray
    shape: np.ndarray  # hash of the shape; 0 stands for none
    digits: np.ndarray  # class of the digit count
    line: np.ndarray  # number of the first token of each line
    features: np.ndarray  # a row of feature buckets for each token
    likely: np.ndarray  # tokens without which a line holds no span


def tokens(text: str) -> Tokens:
    """White-space tokens of a text with shapes, all in numpy; positions are code points."""
    codes = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = np.where(codes < 128, _CLASS[np.minimum(codes, 127)], 1)
    edge = np.flatnonzero(np.diff((kind > 0).view(np.int8))) + 1
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        none = np.zeros(0, np.int64)
        return Tokens(none, none, none, none, none, none.reshape(0, 1), none.astype(bool))
    runs = np.flatnonzero(np.append(True, np.diff(kind) != 0) & (kind > 0))  # a token begins a run, as space comes before it
    first = np.searchsorted(runs, start)
    rank = np.minimum(np.arange(len(runs)) - np.repeat(first, np.diff(np.append(first, len(runs)))), len(_POWERS) - 1)
    worth = (kind[runs] + 1) * _POWERS[rank]
    shape = np.add.reduceat(worth, first)
    counts = {c: np.diff(np.searchsorted(np.flatnonzero(kind == c), np.stack([start, end]), side="left"), axis=0)[0] for c in range(1, 5 + len(_MARKS))}
    breaks = np.flatnonzero(codes == 10)
    line = np.unique(np.concatenate([[0], np.searchsorted(start, breaks)]))
    line = line[line < len(start)]
    digits = np.searchsorted(_DIGIT_BINS, counts[3], side="right")
    # The shape without up to two runs of marks at its end, and its first and last runs.
    last = np.append(first[1:], len(runs)) - 1
    for _ in range(2):
        last = last - (_ENDS[kind[runs[last]]] & (last > first))
    core = np.concatenate([[0], np.cumsum(worth)])
    core = core[last + 1] - core[first]
    of = kind[runs]
    second, but_last = np.minimum(first + 1, last), np.maximum(last - 1, first)
    mark = np.flatnonzero((codes[:-3] == 40) | (codes[:-3] == 91)) if len(codes) > 3 else codes[:0].astype(np.int64)
    mark = mark[(codes[mark + 1] == 97) & (codes[mark + 2] == 116) & ((codes[mark + 3] == 41) | (codes[mark + 3] == 93))]
    spoken = np.zeros(len(start), bool)  # holds "(at)" or "[at]"
    spoken[np.searchsorted(start, mark, side="right") - 1] = True
    dots = _hashed(4, np.minimum(counts[4], 2), np.minimum(counts[5], 4), counts[1] > 0, counts[3] > 0)
    marks = _hashed(5, np.minimum(counts[6], 3), np.minimum(counts[7], 2), np.minimum(counts[8] + counts[9], 2), digits)
    makes = _hashed(6, counts[1] > 0, counts[2] > 0, counts[3] > 0, counts[10] + counts[11] + counts[12] > 0, counts[13] > 0, counts[4 + len(_MARKS)] > 0, spoken)
    own = [_hashed(1, core & 0xFFFFFF, core >> 24 & 0xFFFFFF), _hashed(2, of[first], of[second], np.minimum(last - first, 6)), _hashed(3, of[last], of[but_last], np.minimum(last - first, 3)), dots, marks, makes]
    number = np.repeat(np.arange(len(line)), np.diff(np.append(line, len(start))))

    def beside(salt: int, feature: np.ndarray, step: int) -> np.ndarray:
        """The feature of the token so many places on, in the same line."""
        out = np.zeros_like(feature)
        here, there = (slice(None, -step), slice(step, None)) if step > 0 else (slice(-step, None), slice(None, step))
        out[here] = np.where(number[here] == number[there], _hashed(salt, feature[there]), 0)
        return out

    around = [beside(10 * k + 17 + step, f, step) for k, f in enumerate((dots, marks, makes)) for step in (-1, 1)] + [beside(57 + step, marks, step) for step in (-2, 2)]
    likely = (counts[3] > 0) | (counts[4] > 0) | spoken
    return Tokens(start - 1, end - 1, shape, digits, line, np.stack([*own, *around], 1), likely)


def decodable(t: Tokens) -> Tokens:
    """The tokens of those lines that can hold a span."""
    size = np.diff(np.append(t.line, len(t.start)))
    some = np.add.reduceat(t.likely.astype(np.int64), t.line) > 0 if len(t.line) else np.zeros(0, bool)
    keep = np.repeat(some, size)
    line = np.concatenate([[0], np.cumsum(size[some])])[:-1]
    return Tokens(t.start[keep], t.end[keep], t.shape[keep], t.digits[keep], line.astype(np.int64), t.features[keep], t.likely[keep])


@dataclass(frozen=True)
class Field:
    """Known shapes (sorted hashes), scores by feature and tag, and tag transitions."""

    shapes: np.ndarray
    own: np.ndarray  # a row per shape, the first for unknown ones
    before: np.ndarray
    after: np.ndarray
    digits: np.ndarray
    move: np.ndarray  # from, to
    begin: np.ndarray
    features: np.ndarray | None = None  # a row per feature bucket

    def numbers(self, t: Tokens):
        """Feature rows of each token: own shape, the ones beside it in its line, digit class."""
        at = np.minimum(np.searchsorted(self.shapes, t.shape), len(self.shapes) - 1)
        own = np.where(self.shapes[at] == t.shape, at + 2, 1)  # 0: no token there
        before, after = np.append(0, own[:-1]), np.append(own[1:], 0)
        before[t.line] = 0
        after[(t.line - 1)[t.line > 0]] = 0
        return own, before, after, t.digits

    def scores(self, t: Tokens) -> np.ndarray:
        own, before, after, digits = self.numbers(t)
        out = self.own[own] + self.before[before] + self.after[after] + self.digits[digits]
        for column in t.features.T:
            out += self.features[column]
        return out


def viterbi(scores: np.ndarray, line: np.ndarray, field: Field) -> np.ndarray:
    """Best tags of all tokens; ``line`` holds the first token of each line. Lines advance together, longest first."""
    size = np.diff(np.append(line, len(scores)))
    order = np.argsort(-size, kind="stable")
    first, size = line[order], size[order]
    back = np.zeros(scores.shape, np.uint8)
    best = field.begin + scores[first]
    last = np.zeros_like(best)
    active = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right") if len(size) else np.zeros(0, int)
    for t, n in enumerate(active):
        if t:
            step = best[:n, :, None] + field.move
            at = first[:n] + t
            back[at] = step.argmax(1)
            best[:n] = step.max(1) + scores[at]
        done = active[t + 1] if t + 1 < len(active) else 0
        last[done:n] = best[done:n]
    tags = np.zeros(len(scores), np.int64)
    now = last.argmax(1)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = first[:n] + t
        tags[at] = now[:n]
        now[:n] = back[at, now[:n]]
    return tags


def _logsum(x, axis):
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def _parse(marked: str) -> tuple[str, list[tuple[int, int, int]]]:
    """A marked text as plain text and its (kind, start, end) spans."""
    text, spans, opened = "", [], None
    for part in re.split(r"(</?(?:email|ip|card|phone)>)", marked):
        if part.startswith("</") and opened:
            spans.append((*opened, len(text)))
        elif re.fullmatch(r"<\w+>", part) and part[1:-1] in KINDS:
            opened = (KINDS.index(part[1:-1]), len(text))
        else:
            text += part
    return text, spans


def train(marked: list[str]) -> Field:
    """Maximum likelihood with a ridge penalty, by forward-backward over all examples at once."""
    examples = []
    for text, spans in map(_parse, marked):
        for one in text.split("\n"):
            t = tokens(one)
            if not len(t.start):
                continue
            tag = np.zeros(len(t.start), int)
            for kind, a, b in spans if one == text else []:
                inside = np.flatnonzero((t.start < b) & (t.end > a))
                tag[inside] = 2 + 2 * kind
                tag[inside[:1]] = 1 + 2 * kind
            examples.append((t, tag))
    shapes = np.unique(np.concatenate([t.shape for t, _ in examples]))
    n, bins = len(shapes) + 2, len(_DIGIT_BINS) + 1
    w = [np.zeros((n, TAGS)), np.zeros((n, TAGS)), np.zeros((n, TAGS)), np.zeros((bins, TAGS)), np.zeros((TAGS, TAGS)), np.zeros(TAGS), np.zeros((FEATURES, TAGS))]
    length = max(len(tag) for _, tag in examples)
    real = np.array([[k < len(tag) for k in range(length)] for _, tag in examples])
    gold = np.array([np.pad(tag, (0, length - len(tag))) for _, tag in examples])
    empty = Field(shapes, *w)
    features = np.array([np.pad(t.features, ((0, length - len(t.features)), (0, 0))) for t, _ in examples])
    numbers = [np.array([np.pad(f, (0, length - len(f))) for f in fs]) for fs in zip(*[empty.numbers(t) for t, _ in examples])]
    hot = np.eye(TAGS)[gold] * real[..., None]
    moment, second = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    for step in range(1, ROUNDS + 1):
        scores = sum(x[f] for x, f in zip(w, numbers)) + w[6][features].sum(2)
        forward, backward = np.zeros(scores.shape), np.zeros(scores.shape)
        forward[:, 0] = w[5] + scores[:, 0]
        for k in range(1, length):
            forward[:, k] = np.where(real[:, k, None], _logsum(forward[:, k - 1, :, None] + w[4], 1) + scores[:, k], forward[:, k - 1])
        for k in range(length - 2, -1, -1):
            backward[:, k] = np.where(real[:, k + 1, None], _logsum(w[4] + (scores[:, k + 1] + backward[:, k + 1])[:, None, :], 2), 0)
        total = _logsum(forward[:, -1], 1)
        chance = np.exp(np.where(real[..., None], forward + backward - total[:, None, None], -np.inf))
        rest = chance - hot
        grad = []
        for x, f in zip(w[:4], numbers):
            g = np.zeros_like(x)
            np.add.at(g, f, rest)
            grad.append(g)
        pair = forward[:, :-1, :, None] + w[4] + (scores + backward)[:, 1:, None, :] - total[:, None, None, None]
        pair = np.exp(np.where(real[:, 1:, None, None], pair, -np.inf)) - hot[:, :-1, :, None] * hot[:, 1:, None, :]
        table = np.zeros_like(w[6])
        np.add.at(table, features, rest[:, :, None, :])
        grad += [pair.sum((0, 1)), rest[:, 0].sum(0), table]
        for k, (x, g) in enumerate(zip(w, grad)):
            g = g / len(examples) + (SHAPE_RIDGE if k < 3 else RIDGE) * x
            moment[k] = 0.9 * moment[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            w[k] = x - RATE * (moment[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return Field(shapes, *[x.astype(np.float32) for x in w])


_TRIM = re.compile(r"[A-Za-z0-9(+].*[A-Za-z0-9)]", re.S)
_TRIM_EMAIL = re.compile(r"[A-Za-z0-9].*[A-Za-z0-9]", re.S)


def _possible(kind: int, s: str) -> bool:
    """A tagged span that can't be of its kind isn't added."""
    digits = len(_digits(s))
    if kind == 0:
        return bool(re.fullmatch(r"[^\s@()\[\]]+(@|\x20?\(at\)\x20?|\x20?\[at\]\x20?)[^\s@()\[\]]+\.[^\s@()\[\]]+", s))
    if kind == 1:
        return bool(re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", s)) and all(int(x) <= 255 for x in s.split("."))
    if kind == 2:
        return 13 <= digits <= 19 and not re.search(r"[^0-9 -]", s) and luhn(_digits(s))
    return 7 <= digits <= 15 and not re.search(r"[^0-9 ().+-]", s)


def field_spans(texts: list[str], field: Field) -> list[list[tuple[int, int, int]]]:
    """Spans the field tags in each text, trimmed of marks around them."""
    whole = "\n".join(texts)
    t = decodable(tokens(whole))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(t.start):
        return out
    tags = viterbi(field.scores(t), t.line, field)
    offset = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])])
    lines = np.zeros(len(tags), bool)
    lines[t.line] = True
    k, marked = 0, np.flatnonzero(tags)
    while k < len(marked):
        kind, stop = (tags[marked[k]] - 1) // 2, k + 1
        while stop < len(marked) and marked[stop] == marked[stop - 1] + 1 and tags[marked[stop]] == 2 + 2 * kind and not lines[marked[stop]]:
            stop += 1
        a, b = t.start[marked[k]], t.end[marked[stop - 1]]
        found = (_TRIM if kind else _TRIM_EMAIL).search(whole, a, b)
        if found and _possible(kind, found[0]):
            i = int(np.searchsorted(offset, a, side="right") - 1)
            out[i].append((int(kind), found.start() - int(offset[i]), found.end() - int(offset[i])))
        k = stop
    return out


def find(texts: list[str | None], field: Field) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text, both ordered by kind and start; added spans overlap no base span."""
    texts = [x or "" for x in texts]
    out, begin = [], 0
    while begin < len(texts):
        stop, size = begin, 0
        while stop < len(texts) and (stop == begin or size + len(texts[stop]) <= CHUNK):
            size += len(texts[stop])
            stop += 1
        for text, tagged in zip(texts[begin:stop], field_spans(texts[begin:stop], field)):
            base = base_spans(text)
            added = [s for s in tagged if all(s[2] <= b[1] or s[1] >= b[2] for b in base)]
            out.append((base, sorted([*base, *added])))
        begin = stop
    return out


def _spell(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _report(batch: pa.RecordBatch, field):
    import hashlib

    found = find(batch.column(1).to_pylist(), field.value)
    counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in range(len(KINDS))]
    digest = [hashlib.sha256(_spell(base).encode()).hexdigest() for base, _ in found]
    columns = [batch.column(0), *counts, pa.array(digest, pa.string()), pa.array([_spell(every) for _, every in found], pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])


def mask(text: str, spans) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    out, last = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if a >= last:
            out += [text[last:a], f"<{KINDS[k]}>"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def _masked(batch: pa.RecordBatch, field, name: str):
    texts = batch.column(0).to_pylist()
    clean = [t if t is None else mask(t, spans) for t, (_, spans) in zip(texts, find(texts, field.value))]
    return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(clean, pa.string())], [*batch.schema.names[1:], name])


MARKED = 10_000  # most labelled texts that the field is trained from


def _field(docs: DataFrame, labelled: DataFrame | None):
    """The trained field as a broadcast of a few hundred kilobytes; of ``labelled``'s marked texts at most `MARKED` are drawn, by their hashes."""
    if labelled is None:
        return docs.sparkSession.sparkContext.broadcast(train(list(LABELLED)))
    drawn = labelled.select("text", F.xxhash64("text").alias("h")).filter("text is not null").orderBy("h", "text").limit(MARKED)
    return docs.sparkSession.sparkContext.broadcast(train(sorted(r[0] for r in drawn.collect())))


def personal_data(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every text.

    The counts and the digest are of the spans by the fixed rules; ``spans`` also has
    those that the field adds. Spans of different kinds may overlap by the rules. A null
    text counts as empty; rows and ids stay as they are, so repeated rows are reported alike. Very long texts
    are searched whole, other columns don't matter whatever their names, and an empty table gives none.
    """
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return map_texts(rows, partial(_report, field=_field(docs, labelled)), schema)


def masked_documents(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """The documents with every span of their texts masked and ``n_chars``, if there, counted again.

    All rows and columns stay, whatever the columns' names; null and empty texts stay as they are, very long ones are
    masked whole, repeated rows alike, and an empty table gives none.
    """
    raw, clean = free_name("raw", docs.columns), free_name("clean", docs.columns)
    rows = docs.select(F.col("text").alias(raw), *[ref(c) for c in docs.columns if c != "text"])
    fields = [(f.name.replace("`", "``"), f.dataType.simpleString()) for f in rows.schema.fields[1:]]
    schema = ", ".join([*[f"`{n}` {t}" for n, t in fields], f"{clean} string"])
    out = map_texts(rows, partial(_masked, field=_field(docs, labelled), name=clean), schema).withColumnRenamed(clean, "text")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return out.select(*[ref(c) for c in docs.columns])


def op4_personal_data(spark, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
