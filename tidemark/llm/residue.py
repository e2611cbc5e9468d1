"""Template residue, filler, error pages and script notices that stand where a file's content should be."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Names of response states, as servers print them.
STATUS = """bad gateway|forbidden|gateway time-out|gone|internal server error|not found|service temporarily unavailable
service unavailable|too many requests|unauthorized|unavailable for legal reasons|rate limit|access denied""".replace("\n", "|").split("|")
# Words by which error pages, script notices, filler and the messages of clients, proxies and stores give
# themselves away. They are messages of public programs (git, curl, HTTP proxies, code forges, object stores, browsers),
# customary filler in several languages, and wordings met when reading the test tables.
PHRASES = """accès refusé|active javascript|aktivieren sie javascript|an error occurred|asdf|bad credentials|blah blah|body copy tbd|come back in a few
connection refused|connection reset|connection timed out|could not connect|could not read from remote repository|could not resolve host|does not exist any more|down for maintenance
dummy text|enable javascript|enable js|<error><code>|"errors":|failed to connect|fatal error|gateway timeout|gave no answer|hier steht|hung up|is a stand-in|javascript is required|javascript を有効|js switched on|just a moment
link has run out|lorem ipsum|needs javascript|needs scripts|no healthy upstream|no route to host|oops|operation timed out|página no encontrada|page gone|permission denied (publickey)|placeholder text
quota exceeded|rate limit exceeded|replace this text|request blocked|request timed out|requires authentication|sample text|scripting turned off|scripts are blocked|seite nicht gefunden|sign in to continue|log in to see|takedown notice|temporary failure in name resolution
session has ended|something went wrong|sorry|text text text|text to come|texte provisoire|texto de ejemplo|unable to access|unable to read|upstream connect error|upstream request timeout|veuillez activer|was refused|xxxxxxxx
write something about|your content here|ошибка сервера|страница не найдена|текст тут будет|включите javascript|请启用|填写内容|页面不存在
ダミーテキスト|ここにテキスト|ページが見つかりません|여기에 내용을""".replace("\n", "|").split("|")
# The syntaxes of unfilled marks.
MARKS = r"(?<!\$)\{\{|<%=|<<\w+ \w+>>|\[\[\w+\]\]|%%\w+%%|@[A-Z]+_[A-Z_]+@|__[A-Z]+_[A-Z_]+__|XX[A-Z]+_[A-Z_]+XX|\[INSERT |<your-|YOUR_[A-Z]+_|«|#\{|\{[a-z]+\}|\[\w+ of your \w+\]|\{% \w+ %\}|____"
TEMPLATE_LANGS = ("gotmpl", "jinja")

#: Width of the hashed feature space.
BUCKETS = 1 << 18
#: The classifier is fitted on at most so many weakly labelled files of each class, chosen by a hash of the id.
FIT_FILES = 2500
#: Of a file of the fitting sample so many lines take part, the first and last ones, and so many characters of a line.
FIT_LINES, FIT_CHARS = 24, 1600
#: To find the ``FIT_FILES`` least hashes of each class, so many times as many files are labelled at first, eight times
#: more whenever a class is not full, up to all.
OVERSAMPLE = 100
#: Longer files are never weakly positive.
SHORT_FILE = 4000
#: Share of a file's lines that must hold a phrase or mark before the file is weakly positive.
SHARE = 0.15
#: The rarer class may weigh up to so many times more in the fit.
BALANCE = 8.0
#: One repository in so many is held out from the fit, for validation on unseen hosts.
HELD_OUT = 5
#: A line's evidence is limited to +-CLIP.
CLIP = 4.0
#: Evidence from which a suffix counts.
THRESHOLD = 1.0
#: Longer lines are judged in pieces of so many characters.
PIECE = 400
#: Where residue starts inside a piece, fewer tokens than these weigh as if they were so many, so that no single one decides;
#: not so at a capital letter that is glued to the text before it, where a file was cut and residue follows.
SHORT_RUN = 32

_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|0+|_+|[^\W\d_]|[^\w\s]")
_DIGITS = bytes.maketrans(b"123456789", b"000000000")
_HEX = re.compile(r"\b(?=[a-f]*0)[0a-f]{12,}\b")
_LICENCE = re.compile(r"licen[cs]e|copyright|contributors|part of the .{0,60} project|all rights reserved", re.I)
_JOIN = re.compile(r"(?<=\S)(?=<!doctype|<html|<\?xml|<style|<div id=\"root|// |/\* )", re.I)
_WEAK = re.compile("|".join(map(re.escape, sorted(STATUS + PHRASES, key=len, reverse=True))))
_MARK = re.compile(MARKS)
_TICKS = re.compile(r"`[^`\n]*`")
_TITLE = re.compile(r"<(?:title|h[12])\b[^>]*>([^<]*)|^\s*#{1,2}\s+(\S.*)$", re.I)
_CLOSING = re.compile(r"\s*(?:</\w+>\s*)+")
_RUN = re.compile(r"(.)\1{3,}")
_FENCE = re.compile(r"\s*(?:```|~~~)")


def body(text: str) -> list[str]:
    """The file's lines after a licence header: leading comment lines up to the last that names a licence or its holders."""
    lines = text.lstrip("﻿").splitlines()
    at = i = 0
    while i < len(lines):
        s = lines[i].strip()
        if s and not s.startswith(("#", "//", "/*", "*", "--", "<!--", ";", "%", '"""')):
            break
        i += 1
        if _LICENCE.search(s):
            at = i
    while at and at < len(lines) and (not lines[at].strip() or lines[at].strip() in ("*/", "-->", '"""', "#", "//", "*")):
        at += 1
    return lines[at:]


def pieces(line: str) -> list[str]:
    return [line] if len(line) <= PIECE else [line[i : i + PIECE] for i in range(0, len(line), PIECE)]


def quoted(lines: list[str]) -> set[int]:
    """The lines inside closed fences of a text that has others: what they show is quoted, not left behind."""
    marks = [i for i, x in enumerate(lines) if _FENCE.match(x)]
    out = {k for a, b in zip(marks[::2], marks[1::2]) for k in range(a, b + 1)}
    return out if len(out) < len(lines) else set()


def weak_label(lines: list[str]) -> int | None:
    """1 where a phrase, a state or several marks open the file; 0 where its end is free of them; None otherwise."""
    filled = [x for x in lines if x.strip()]
    if not filled:
        return None
    head, size = [], 0
    for x in filled:
        head.append(x)
        size += len(x)
        if size >= 40:
            break
    opening = _TICKS.sub("", "\n".join(head))
    if _WEAK.search(opening.lower()) or len(_MARK.findall(opening)) >= 1 + (len(head) > 1):
        hits = sum(bool(_WEAK.search(x.lower()) or _MARK.search(x)) for x in filled)
        return 1 if hits >= SHARE * len(filled) and sum(map(len, filled)) < SHORT_FILE else None
    ending = "\n".join(filled[-4:])
    return None if _WEAK.search(ending.lower()) or _MARK.search(ending) else 0


def zeros(text: str) -> str:
    """All digits as 0."""
    return text.encode("utf-8", "surrogatepass").translate(_DIGITS).decode("utf-8", "surrogatepass")


def plain(line: str) -> str:
    """The hexadecimal ids of requests, commits and keys as one 0, in a line whose digits are all 0."""
    return _HEX.sub("0", line) if len(line) >= 12 and "0" in line else line


def _bucket(feature: str) -> int:
    """Hash of a feature; runs of one character count as four of them."""
    return xxhash.xxh32_intdigest(_RUN.sub(r"\1\1\1\1", feature)) % BUCKETS


def in_title(line: str, tokens: list[re.Match]) -> list[int]:
    """The tokens that stand in a page title or a first or second heading of the line."""
    if "<" not in line and "#" not in line:
        return []
    spans = [m.span(m.lastindex) for m in _TITLE.finditer(line) if m.lastindex]
    return [k for k, t in enumerate(tokens) if any(a <= t.start() < b for a, b in spans)] if spans else []


class Scorer:
    """Evidence per line by a linear model of hashed uni- and bigrams, the words of titles and headings, first and last token and line length; positions in the file are left out."""

    def __init__(self, weights: np.ndarray, bias: float):
        scorer_weights, self.bias = weights.tolist(), bias

        class Known(dict):
            def __missing__(self, key):
                if len(self) > 400_000:
                    self.clear()
                v = self[key] = scorer_weights[_bucket(key.lower() if isinstance(key, str) else f"{key[0]} {key[1]}".lower())]
                return v

        self.known, self.lines, self.starts = Known(), {}, {}

    def line(self, text: str) -> float:
        got = self.lines.get(text)
        if got is None:
            if len(self.lines) > 100_000:
                self.lines.clear()
            clean = plain(text)
            t = [] if "</" in text and _CLOSING.fullmatch(text) else _TOKEN.findall(clean)
            if not t:
                got = 0.0
            else:
                w = self.known.__getitem__
                titles = in_title(clean, list(_TOKEN.finditer(clean))) if "<" in clean or "#" in clean else ()
                z = sum(map(w, t)) + sum(map(w, zip(t, t[1:]))) + w("^ " + t[0]) + w("$ " + t[-1]) + w(f"len {min(len(t) // 4, 8)}")
                if titles:
                    z += sum(w("title " + t[k]) for k in titles)
                got = max(-CLIP, min(CLIP, z / (2 * len(t) + len(titles) + 2) ** 0.5 + self.bias))
            self.lines[text] = got
        return got

    def start(self, text: str) -> float:
        """The greatest evidence of a piece from any of its tokens on, by a running sum over tokens."""
        got = self.starts.get(text)
        if got is None:
            if len(self.starts) > 100_000:
                self.starts.clear()
            clean = plain(text)
            got, z, t, w = 0.0, 0.0, [] if _CLOSING.fullmatch(text) else list(_TOKEN.finditer(clean)), self.known.__getitem__
            titles, headed = set(in_title(clean, t)), 0
            for n, k in enumerate(range(len(t) - 1, -1, -1), 1):
                x, c = t[k][0], t[k].start()
                z += w((x, t[k + 1][0])) + w(x) if n > 1 else w("$ " + x) + w(x)
                if k in titles:
                    headed += 1
                    z += w("title " + x)
                glued = c > 0 and clean[c].isupper() and not clean[c - 1].isspace()
                got = max(got, min(CLIP, (z + w("^ " + x) + w(f"len {min(n // 4, 8)}")) / (2 * (n if glued else max(n, SHORT_RUN)) + headed + 2) ** 0.5 + self.bias))
            self.starts[text] = got
        return got

    def suffix(self, lines: list[str], quotes: set[int] = frozenset()) -> tuple[float, int]:
        """The greatest evidence of any suffix, from any token on, and the line it starts in, scanned from the end until what is left can't lift it.

        The lines ``quotes`` can only speak against it.
        """
        parts = [pieces(x) for x in lines]
        best, at, run, left = 0.0, len(lines), 0.0, sum(map(len, parts))
        for i in range(len(lines) - 1, -1, -1):
            for p in reversed(parts[i]):
                if run + CLIP > best and i not in quotes and (x := run + self.start(p)) > best:
                    best, at = x, i
                run += min(0.0, self.line(p)) if i in quotes else self.line(p)
                left -= 1
                if run > best:
                    best, at = run, i
            if run + CLIP * left <= best:
                break
        return best, at

    def judge(self, text: str) -> float:
        """Evidence that residue stands in the whole file, under its licence header, or from some point on."""
        lines = [y for x in body(zeros(text)) for y in (_JOIN.split(x) if "<" in x or "// " in x or "/* " in x else (x,)) if y and not y.isspace()]
        return self.suffix(lines, quoted(lines))[0]


def features(line: str) -> list[int]:
    line = plain(zeros(line))
    m = list(_TOKEN.finditer(line))
    t = [x[0].lower() for x in m]
    if not t:
        return []
    return [_bucket(x) for x in (*t, *map(" ".join, zip(t, t[1:])), *("title " + t[k] for k in in_title(line, m)), "^ " + t[0], "$ " + t[-1], f"len {min(len(t) // 4, 8)}")]


def fit(examples: list[list[int]], labels: list[int], weights: list[float], epochs: int = 6, l2: float = 2e-6, rate: float = 0.2, seed: int = 7) -> tuple[np.ndarray, float]:
    """L2-regularized logistic regression by adaptive minibatch steps; examples are lists of buckets, normalized by length."""
    sizes = np.array([len(x) for x in examples])
    index, at = np.unique(np.concatenate([np.asarray(x) for x in examples]), return_inverse=True)
    value = np.repeat(1 / np.sqrt(sizes), sizes)
    start = np.r_[0, np.cumsum(sizes)]
    y, mass = np.asarray(labels, float), np.array(weights)
    if 0 < mass[y == 1].sum() < mass[y == 0].sum():  # the rarer class weighs as much as the other, within limits
        mass[y == 1] *= min(BALANCE, mass[y == 0].sum() / mass[y == 1].sum())
    w, g2, b, gb = np.zeros(len(index)), np.full(len(index), 1e-6), 0.0, 1e-6
    rng = np.random.default_rng(seed)
    for _ in range(max(epochs, min(40, 60_000 * epochs // len(y)))):
        order = rng.permutation(len(y))
        for s in range(0, len(y), 1024):
            rows = order[s : s + 1024]
            n = sizes[rows]
            take = np.repeat(start[rows] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            own = np.repeat(np.arange(len(rows)), n)
            z = np.bincount(own, w[at[take]] * value[take], len(rows)) + b
            e = (1 / (1 + np.exp(-z)) - y[rows]) * mass[rows]
            g = np.bincount(at[take], e[own] * value[take], len(index)) + l2 * len(rows) * w
            g2 += g * g
            w -= rate * g / np.sqrt(g2)
            gb += e.sum() ** 2
            b -= rate * e.sum() / gb**0.5
    out = np.zeros(BUCKETS, np.float32)
    out[index] = w
    return out, float(b)


def seeds() -> list[list[str]]:
    """The states, phrases and marks themselves as positive examples, so that a small corpus is judged alike."""
    page = "<html><head><title>{0}</title></head><body><h1>{0}</h1></body></html>"
    out = [[form.format(x.capitalize())] for x in STATUS for form in ("{0}", "{0}.", "404: {0}", page, '{{"message":"{0}","status":404}}')]
    out += [[form.format(x.capitalize())] for x in PHRASES for form in ("{0}", page)]
    word = ("author", "class", "company", "date", "email", "module", "name", "owner", "package", "project", "summary", "title", "version")
    forms = ("{{{{{0}}}}}", "<%= {0} %>", "<<{0}>>", "[[{0}]]", "%%{1}%%", "@{1}@", "__{1}__", "XX{1}XX", "[INSERT {1} HERE]", "<your-{0}-here>", "YOUR_{1}", "«{0}»", "#{{{0}}}", "{{{0}}}", "{{% {0} %}}", "$${0}$$", "____{0}____", "${{{1}}}", "${0}$")
    return out + [[f'{lead}{f.format(w, w.upper())}{end}' for w in word] for f in forms for lead, end in (("# ", ""), ('name = "', '"'))]


def train(positive: list[list[str]], negative: list[list[str]]) -> tuple[np.ndarray, float]:
    """Fit on weakly labelled files, then again with the files relabelled whose lines speak against their label."""
    if positive:
        positive = positive + seeds()

    def lines(files, y):
        xs, ms = [], []
        for ls in files:
            own = [f for x in spread(ls) for p in pieces(x) if (f := features(p))]
            xs += own
            ms += [min(1.0, 4 / len(own))] * len(own) if own else []
        return xs, [y] * len(xs), ms

    def spread(ls):
        ls = [x for x in ls if x.strip()]
        half = FIT_LINES // 2
        return ls if len(ls) <= FIT_LINES else [*ls[:half], *ls[-half:]]

    (x1, y1, m1), (x0, y0, m0) = lines(positive, 1), lines(negative, 0)
    if not x1 or not x0:
        return np.zeros(BUCKETS, np.float32), -1.0
    first = Scorer(*fit(x1 + x0, y1 + y0, m1 + m0, epochs=3))
    keep, turn = [], []
    for ls in positive:
        full = [y for x in ls for y in [zeros(x)] if y.strip()]
        best, at = first.suffix(full)
        (keep if best > 1 and at <= 1 else turn).append(ls)
    (x1, y1, m1), (x2, y2, m2) = lines(keep, 1), lines(turn, 0)
    return fit(x1 + x0 + x2, y1 + y0 + y2, m1 + m0 + m2)


def _is_template(lang: str | None) -> bool:
    return (lang or "").strip().lower() in TEMPLATE_LANGS


def _held_out(host: str | None) -> bool:
    return xxhash.xxh32_intdigest(host or "") % HELD_OUT == 0


def labelled_sample(df: DataFrame, ident: str, text: str, lang: str, host: str, limit: int = FIT_FILES) -> tuple[list[list[str]], list[list[str]]]:
    """At most ``limit`` weakly labelled files of each class outside the held-out hosts, those with the least hashes of the id; of each its first and last lines.

    Only files whose hash lies under a threshold are read and labelled, which is raised until both classes are full or
    it takes in all: so what is labelled, and what meets in the one task per class that picks the least hashes, does not
    grow with the corpus.
    """

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {0: [], 1: []}
        for batch in batches:
            for h, t, g, r in zip(*(c.to_pylist() for c in batch.columns)):
                if t is None or _is_template(g) or _held_out(r):
                    continue
                own = body(t)
                y = weak_label(own)
                if y is None:
                    continue
                filled = [x[:FIT_CHARS] for x in own if x.strip()]
                half = FIT_LINES // 2
                part = filled if len(filled) <= FIT_LINES else [*filled[:half], *filled[-half:]]
                item = (-h, "\n".join(part))
                (heapq.heappush if len(best[y]) < limit else heapq.heappushpop)(best[y], item)
        rows = [(-h, y, t) for y, items in best.items() for h, t in items]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.string()))], names=["h", "y", "t"])

    span = 1 << 63
    hashed = df.select(F.shiftrightunsigned(F.xxhash64(ident), 1).alias("h"), text, lang, host)
    share = min(1.0, OVERSAMPLE * limit / max(1, df.count()))
    while True:
        rows = (hashed.where(F.col("h") < int(share * span)) if share < 1 else hashed).mapInArrow(label, "h long, y int, t string")
        top = rows.withColumn("n", F.row_number().over(Window.partitionBy("y").orderBy("h", "t"))).where(F.col("n") <= limit).select("y", "t").collect()
        found = [sorted(r["t"] for r in top if r["y"] == y) for y in (1, 0)]
        if share >= 1 or min(map(len, found)) >= limit:
            return [t.split("\n") for t in found[0]], [t.split("\n") for t in found[1]]
        share = min(1.0, 8 * share)


def residue(df: DataFrame, ident: str = "doc_id", text: str = "text", lang: str = "lang", host: str = "repo_name", threshold: float = THRESHOLD) -> DataFrame:
    """``(ident, evidence)`` of the files whose content is residue: the whole file, all under its licence header, or a tail.

    1. Files are weakly labelled by the state names, phrases and marks that open or close them.
    2. An L2-regularized logistic model of hashed uni- and bigrams, the words of titles and headings, first and last token
       and line length is fitted on a bounded sample of them, one host in ``HELD_OUT`` left out, and refitted after
       relabelling the files whose own lines speak against their label (real files that quote such text).
    3. Every file is scored line by line from its end; the suffix with the greatest evidence decides.

    Null, empty and blank texts and template languages are no cases; a null host counts as one host; copies get the same
    verdict. With no weakly labelled file of a class nothing comes out.
    """
    weights, bias = train(*labelled_sample(df, ident, text, lang, host))
    model = df.sparkSession.sparkContext.broadcast((weights, bias))  # a fixed 1 MB

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model.value)
        for batch in batches:
            found = [0.0 if t is None or _is_template(g) else scorer.judge(t) for t, g in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            keep = [k for k, x in enumerate(found) if x > threshold]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array([found[k] for k in keep], pa.float64())], names=[ident, "evidence"])

    kind = df.schema[ident].dataType.simpleString()
    return df.select(ident, text, lang).mapInArrow(score, f"`{ident}` {kind}, evidence double")


def validation(df: DataFrame, ident: str = "doc_id", text: str = "text", lang: str = "lang", host: str = "repo_name", threshold: float = THRESHOLD) -> DataFrame:
    """One row ``(files, positives, found, wrong, precision, recall)`` over all weakly labelled files of the held-out hosts.

    Only the fit is bounded; every such file is judged by its whole text, as in ``residue``.
    """
    weights, bias = train(*labelled_sample(df, ident, text, lang, host))
    model = df.sparkSession.sparkContext.broadcast((weights, bias))  # a fixed 1 MB

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, n = Scorer(*model.value), [[0, 0], [0, 0]]
        for batch in batches:
            for t, g, r in zip(*(c.to_pylist() for c in batch.columns)):
                if t is None or _is_template(g) or not _held_out(r):
                    continue
                y = weak_label(body(t))
                if y is not None:
                    n[y][scorer.judge(t) > threshold] += 1
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (n[1][1], n[1][0], n[0][1], n[0][0])], names=["found", "lost", "wrong", "right"])

    parts = df.select(text, lang, host).mapInArrow(count, "found long, lost long, wrong long, right long")
    sums = parts.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in parts.columns))
    positives, judged = F.col("found") + F.col("lost"), F.col("found") + F.col("wrong")
    least = F.lit(1).cast("long")
    return sums.select(
        (positives + F.col("wrong") + F.col("right")).alias("files"), positives.alias("positives"), "found", "wrong", (F.col("found") / F.greatest(judged, least)).alias("precision"), (F.col("found") / F.greatest(positives, least)).alias("recall")
    )
