"""Personal data by a semi-Markov conditional random field over candidate spans.

Fixed patterns find the plain forms. Islands of text that hold enough digits, a spelled-out address or a long run of
letters and digits are tokenised and segmented jointly: every candidate segment is scored by features of the whole span
(digit counts, check sums, part values, separators, mixture of characters, cue words before it) and dynamic programming
over bounded segment lengths picks boundaries and kinds together. The weights are trained here, on sentences made from
templates.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakegraph.llm.common import map_texts, set_aside

#: Kinds of the fixed patterns, and all kinds: secrets are found by the field alone.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
Span = tuple[int, int, int]  # start, end (exclusive), kind


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_emails(text: str) -> list[Span]:
    """Leftmost matches, found from each ``@`` so that long words cost no more than once."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), 0))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[Span]:
    """The fixed patterns' spans of each kind, by start and kind."""
    out = base_emails(text)
    if any(d in text for d in "0123456789"):
        out += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            out += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 10 <= len(digits_of(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


#: Where it is worth to look: seven digits that stand close together, numbers with bracketed dots, a spelled-out at sign,
#: or sixteen characters and more in one run of letters and digits.
DIGITS = re.compile(r"(?<![0-9])[0-9](?:[^\w\n]{0,3}[0-9]){6,}|(?<![0-9])[0-9]+(?:[\[(]\.[\])][0-9]+){3}")
SPELLED = re.compile(
    r" ?(?:\(at\)|\[at\]|(?<= )at ) ?[A-Za-z0-9-]+(?: ?(?:\(dot\)|\[dot\]|(?<= )dot ) ?[A-Za-z]+)+", re.IGNORECASE
)
RUN = re.compile(r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*[0-9])(?=[0-9_+/-]*[A-Za-z])[A-Za-z0-9_+/-]{16,}+=*")
LOCAL_LIKE = LOCAL_CHARS - {"%", "+"}


def islands(text: str) -> list[tuple[int, int]]:
    """Parts of the text that are segmented; overlapping ones are one."""
    out = []
    if any(d in text for d in "0123456789"):
        out = [m.span() for m in DIGITS.finditer(text)] + [m.span() for m in RUN.finditer(text)]
    for m in SPELLED.finditer(text):
        a = m.start()
        while a > 0 and text[a - 1] in LOCAL_LIKE:
            a -= 1
        if a < m.start():
            out.append((a, m.end()))
    merged: list[tuple[int, int]] = []
    for a, b in sorted(out):
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


TOKEN = re.compile(RUN.pattern + r"|[0-9]+|[A-Za-z]+|[^\sA-Za-z0-9]")
CUE = re.compile(
    r"(tel|phone|call|fax|mobile|telefon\w*|tel[eé]f\w*)|(card|visa|carte|karte|tarjeta)|(ip|host|server|addr\w*)"
    r"|(mail|e-mail|contact\w*|write|correo)|(token|secret|passw\w*|api|key|bearer|auth\w*|credential\w*)",
    re.IGNORECASE,
)
CUE_REACH = 24
MOST_TOKENS = 14
MOST_DIGITS = 19
#: Groups of digits that one number has at most; four where it has under ten digits.
MOST_GROUPS = 8
FEATURES = (
    "bias", "digits 10-15", "digits 14-19", "luhn", "four parts up to 255", "dots in brackets", "groups of 4", "groups of 2-4",
    "mixed separators", "cue phone", "cue card", "cue ip", "cue mail", "cue secret", "at and dot", "digits and letters",
    "ends in letters", "begins with 0 or bracket", "touches letters or digits", "known ending", "bracketed words",
    "phone shape", "one run", "run of hex digits", "run that changes often", "run with few digits", "assigned", "known key prefix",
)
ENDINGS = ("com", "org", "net", "edu", "info", "io", "eu", "de", "fr", "es", "it", "uk")
SHAPE = re.compile(r"(?:\([0-9]{2,4}\)|[0-9]{2,4})[ -][0-9]{3,4}[ -][0-9]{4}")
AT_DOT = re.compile(r"[a-z0-9._-]+ ?(?:\(at\)|\[at\]|at) ?[a-z0-9-]+(?: ?(?:\(dot\)|\[dot\]|dot) ?[a-z]+)+", re.IGNORECASE)
BRACKETED = re.compile(r"\[\.\]|\(\.\)")
CHANGE = re.compile("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")
KEY_PREFIX = re.compile("AKIA|gh[pousr]_|sk[-_]|xox[abp]-|eyJ|AIza")
ASSIGNED = re.compile("[=:][ ]?[\"']?$")


def candidate(text: str, tokens: list[tuple[int, int]], i: int, j: int) -> np.ndarray | None:
    """Features of the segment of tokens i to j (inclusive); None if it can hold nothing."""
    a, b = tokens[i][0], tokens[j][1]
    span = text[a:b]
    digits = digits_of(span)
    letters = any(c.isalpha() for c in span)
    run = i == j and letters and len(digits) > 0
    spelled = not run and AT_DOT.fullmatch(span) is not None
    groups = [] if run else re.findall("[0-9]+", span)
    if not run and not spelled and (letters or len(groups) > MOST_GROUPS or len(digits) < 10 and len(groups) != 4):
        return None
    cue = [0] * len(KINDS)
    for m in CUE.finditer(text, max(0, a - CUE_REACH), a):
        cue[m.lastindex - 1] = 1
    near = (a > 0 and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum())
    n = len(digits)
    seps = set() if run else set(re.sub("[0-9]", "", span))
    numbers = [
        not run and 10 <= n <= 15,
        not run and 14 <= n <= 19,
        not run and 14 <= n <= 19 and luhn(digits),
        len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups),
        not run and BRACKETED.search(span) is not None,
        len(groups) > 1 and all(len(g) == 4 for g in groups),
        len(groups) > 1 and all(2 <= len(g) <= 4 for g in groups),
        len(seps) > 2,
    ]
    words = [
        spelled,
        not run and letters and n > 0,
        not run and letters,
        not run and span[0] in "0(" and not letters,
        near,
        spelled and groups_end(span) in ENDINGS,
        spelled and ("[" in span or "(" in span),
        not run and SHAPE.fullmatch(span) is not None,
    ]
    runs = [
        run,
        run and all(c in "0123456789abcdefABCDEF" for c in span),
        run and len(CHANGE.findall(span)) * 6 >= len(span),
        run and n * 8 < len(span),
        run and ASSIGNED.search(text, max(0, a - 4), a) is not None,
        run and KEY_PREFIX.match(span) is not None,
    ]
    return np.array([1, *numbers, *cue, *words, *runs], float)


def groups_end(span: str) -> str:
    return re.split(r"[^a-z]", span.lower())[-1]


def segments(text: str, start: int, end: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, np.ndarray]]]:
    """Tokens of a part of the text, and the candidate segments (i, j, features) over them."""
    tokens = [m.span() for m in TOKEN.finditer(text, start, end)]
    found = []
    dotted = BRACKETED.search(text, start, end) is not None
    for i, (a, _) in enumerate(tokens):
        if not (text[a].isalnum() or text[a] == "("):
            continue
        n = groups = words = 0
        for j in range(i, min(len(tokens), i + MOST_TOKENS)):
            c = text[tokens[j][0]]
            if c.isdigit():
                n, groups = n + tokens[j][1] - tokens[j][0], groups + 1
            words += c.isalpha() or tokens[j][1] - tokens[j][0] > MOST_DIGITS
            if j > i and (n > MOST_DIGITS or groups > MOST_GROUPS):
                break
            if c.isalnum() and (words or n >= 10 or dotted and groups == 4) and (f := candidate(text, tokens, i, j)) is not None:
                found.append((i, j, f))
    return tokens, found


def decode(n: int, found: list[tuple[int, int, np.ndarray]], weights: np.ndarray) -> list[tuple[int, int, int]]:
    """The best segmentation of n tokens: segments (i, j, kind) of positive worth against tokens outside."""
    best, back = np.zeros(n + 1), [None] * (n + 1)
    ends: dict[int, list] = {}
    for i, j, f in found:
        ends.setdefault(j + 1, []).append((i, f))
    for t in range(1, n + 1):
        best[t], back[t] = best[t - 1], None
        for i, f in ends.get(t, ()):
            worth = weights @ f
            k = int(worth.argmax())
            if best[i] + worth[k] > best[t] + 1e-9:
                best[t], back[t] = best[i] + worth[k], (i, k)
    out, t = [], n
    while t:
        if back[t] is None:
            t -= 1
        else:
            out.append((back[t][0], t - 1, back[t][1]))
            t = back[t][0]
    return out[::-1]


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + float(np.log(np.exp(np.array(values) - top).sum()))


def gradient(n: int, found: list, gold: set, weights: np.ndarray) -> np.ndarray:
    """Of the log likelihood of the gold segments (i, j, kind), by the forward-backward recursions over segments."""
    ends, starts = {}, {}
    worth = [weights @ f for _, _, f in found]
    for x, (i, j, _) in enumerate(found):
        ends.setdefault(j + 1, []).append(x)
        starts.setdefault(i, []).append(x)
    fwd, bwd = [0.0] * (n + 1), [0.0] * (n + 1)
    for t in range(1, n + 1):
        fwd[t] = _log_sum([fwd[t - 1], *(fwd[found[x][0]] + w for x in ends.get(t, ()) for w in worth[x])])
    for t in range(n - 1, -1, -1):
        bwd[t] = _log_sum([bwd[t + 1], *(bwd[found[x][1] + 1] + w for x in starts.get(t, ()) for w in worth[x])])
    g = np.zeros_like(weights)
    for x, (i, j, f) in enumerate(found):
        p = np.exp(fwd[i] + worth[x] + bwd[j + 1] - fwd[n])
        for k in range(len(KINDS)):
            g[k] += f * (((i, j, k) in gold) - p[k])
    return g


def sentences(count: int, seed: int) -> list[tuple[str, list[Span]]]:
    """Made-up sentences with spans in forms that the fixed patterns miss, and with look-alikes that hold nothing."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[rng.integers(len(x))]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))

    def card() -> str:
        d = pick("4", "5") + digits(14)
        return next(d + str(c) for c in range(10) if luhn(d + str(c)))

    mixed = lambda n, of: "".join(rng.choice(list(of), n))
    plain = "abcdefghijklmnopqrstuvwxyz"

    def secret() -> str:
        hexed, wide = mixed(int(rng.integers(32, 65)), "0123456789abcdef"), mixed(int(rng.integers(20, 45)), plain + plain.upper() + "0123456789")
        return pick(hexed, hexed, wide, "ghp_" + wide, "sk-" + wide, "AKIA" + mixed(16, plain.upper() + "0123456789"))

    def one() -> tuple[str, int | None]:
        kind = rng.integers(13)
        if kind in (8, 9):
            name, mark = pick("token", "secret", "api_key", "password", "access key", "auth token"), pick(' = "', "=", ": ", " = ")
            return name + mark + "|" + secret() + ("|" + '"' if '"' in mark else ""), 4
        if kind >= 11:
            d = pick(digits(12), digits(15), digits(16), digits(16), digits(16))
            return pick("", "", "order ", "no. ", "id ") + (d if not luhn(d) else d[:-1] + str((int(d[-1]) + 1) % 10)), None
        if kind == 10:
            word = mixed(int(rng.integers(10, 16)), plain)
            return pick("item ", "page ", "see ", "") + pick(word + digits(6), f"{word}-{word}-{digits(2)}", f"{word}_{digits(4)}_{word}", f"{word}/{word}/{digits(3)}"), None
        if kind == 0:
            w = lambda: "".join(rng.choice(list("abcdeimnorst"), rng.integers(3, 8)))
            at, dot = pick((" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"))
            return pick("", "mail ", "contact ") + f"{w()}{at}{w()}{dot}{pick('com', 'org', 'net')}", 0
        if kind == 1:
            return pick("", "host ", "server ") + pick("[.]", "(.)").join(str(x) for x in rng.integers(0, 256, 4)), 1
        if kind in (2, 3):
            c = card()
            return pick("", "card ", "visa ") + pick(c, ".".join((c[:4], c[4:8], c[8:12], c[12:])), "/".join((c[:4], c[4:8], c[8:12], c[12:]))), 2
        if kind == 4:
            return pick("tel ", "phone ", "call ", "tel. ") + pick(f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"0{digits(2)} {digits(4)} {digits(4)}"), 3
        if kind == 5:
            return pick("order ", "no. ", "total ", "in ") + pick(digits(8), digits(12), digits(16)[:15] + "x", f"{digits(4)} {digits(4)}", f"{digits(3)}.{digits(3)}.{digits(3)}"), None
        if kind == 6:
            return f"{digits(4)}-{digits(2)}-{digits(2)} {digits(2)}:{digits(2)}:{digits(2)}", None
        return "we look at the dot on it", None

    out = []
    for _ in range(count):
        text, spans = "", []
        for _ in range(int(rng.integers(1, 4))):
            text += pick("so ", "it was ", "see ", "and then ")
            body, kind = one()
            if kind == 4:
                before, inside, *after = body.split("|")
                spans.append((len(text) + len(before), len(text) + len(before) + len(inside), kind))
                text += before + inside + "".join(after)
            else:
                cue = re.match(r"(?:mail|contact|host|server|card|visa|tel\.?|phone|call) ", body)
                a = len(text) + (cue.end() if cue else 0)
                text += body
                if kind is not None:
                    spans.append((a, len(text), kind))
            text += pick(", ", ". ", " and ")
        out.append((text, spans))
    return out


@functools.cache
def train(count: int = 240, rounds: int = 25, seed: int = 0, rate: float = 0.5, decay: float = 1e-3) -> np.ndarray:
    """Weights (kind by feature): gradient ascent with per-weight steps on the penalised log likelihood."""
    data = []
    for text, spans in sentences(count, seed):
        tokens, found = segments(text, 0, len(text))
        where = {(tokens[i][0], tokens[j][1]): (i, j) for i, j, _ in found}
        data.append((len(tokens), found, {(*where[a, b], k) for a, b, k in spans if (a, b) in where}))
    w, seen = np.zeros((len(KINDS), len(FEATURES))), np.full((len(KINDS), len(FEATURES)), 1e-6)
    for _ in range(rounds):
        g = sum(gradient(*d, w) for d in data) / len(data) - decay * w
        seen += g * g
        w = w + rate * g / np.sqrt(seen)
    return w


def covered(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of the spans, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b, _ in spans:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def added_spans(text: str, base: list[Span], weights: np.ndarray) -> list[Span]:
    """Segments in the text's islands that don't overlap a span of the fixed patterns. ``base`` is sorted by start."""
    starts, ends = covered(base)

    def free(a: int, b: int) -> bool:
        at = bisect_right(ends, a)
        return at == len(starts) or starts[at] >= b

    out = []
    done = 0
    for start, end in islands(text):
        if start > done and text[start - 1] == "(":
            start -= 1
        done = end
        at = bisect_right(starts, start) - 1
        if at >= 0 and ends[at] >= end:
            continue
        tokens, found = segments(text, start, end)
        found = [x for x in found if free(tokens[x[0]][0], tokens[x[1]][1])]
        out += [(tokens[i][0], tokens[j][1], k) for i, j, k in decode(len(tokens), found, weights)]
    return out


def written_spans(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def all_spans(text: str, weights: np.ndarray) -> tuple[list[Span], list[Span]]:
    """The fixed patterns' spans, and those together with the field's, both by start and kind."""
    base = base_spans(text)
    return base, sorted([*base, *added_spans(text, base, weights)], key=lambda s: (s[0], s[2], s[1]))


OUT = "_email long, _ip long, _card long, _phone long, _base string, _spans string, _n_spans long"


def find_spans(df: DataFrame, text: str) -> DataFrame:
    """Replaces ``text`` by ``_email``, ``_ip``, ``_card``, ``_phone`` (spans of the fixed patterns), ``_base`` and ``_spans``
    (``kind:start:end`` in code points, comma-joined) and ``_n_spans``, the number of all spans.

    Null and empty texts have none; repeated rows have the same ones; an empty table stays empty. Texts are taken whole; time
    grows with their length, not with its square. The base spans are always among the spans; segments that the field adds
    never overlap them. Of ties in the field's worth the segment that ends first wins. A caller's column with an output
    column's name goes on under its name and ``_given``.
    """
    shared = df.sparkSession.sparkContext.broadcast(train())

    def make(texts: list[bytes | None]) -> dict[str, list]:
        out: dict[str, list] = {x.split()[0]: [] for x in OUT.split(", ")}
        for raw in texts:
            base, spans = all_spans((raw or b"").decode(), shared.value)
            for k, name in enumerate(BASE_KINDS):
                out[f"_{name}"].append(sum(s[2] == k for s in base))
            out["_base"].append(written_spans(base))
            out["_spans"].append(written_spans(spans))
            out["_n_spans"].append(len(spans))
        return out

    return map_texts(set_aside(df, OUT), text, OUT, make)


def document_spans(docs: DataFrame) -> DataFrame:
    """The query's digest; ``n_spans`` counts the spans of all kinds, secrets included."""
    out = find_spans(docs.select("doc_id", F.col("text").alias("_text")), "_text")
    counts = [F.col(f"_{k}").alias(f"n_{k}") for k in BASE_KINDS]
    return out.select(
        "doc_id", *counts, F.sha2("_base", 256).alias("base_sha256"), F.col("_spans").alias("spans"), F.col("_n_spans").alias("n_spans"),
        (F.col("_n_spans") > 0).alias("has_personal_data"),
    )


def masked_rows(docs: DataFrame) -> DataFrame:
    """Whole documents with each span replaced by its kind in brackets; overlapping spans are merged under the first. Null stays null."""
    packed = docs.select(F.struct("*").alias("_doc"), F.col("text").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(train())

    def make(texts: list[bytes | None]) -> dict[str, list]:
        out = []
        for raw in texts:
            text, done, parts = (raw or b"").decode(), 0, []
            for a, b, k in all_spans(text, shared.value)[1]:
                if a >= done:
                    parts += [text[done:a], f"[{KINDS[k]}]"]
                done = max(done, b)
            out.append(None if raw is None else "".join([*parts, text[done:]]))
        return {"_masked": out}

    out = map_texts(packed, "_text", "_masked string", make)
    return out.select(*((F.col("_masked") if c == "text" else F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns))
