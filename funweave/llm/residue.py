"""Template residue, filler, error messages and demands for scripts (problem 10).

A text is read in segments (lines and sentences). Response-status and phrase patterns give weak labels to segments; a
regularised logistic regression is fitted on a bounded number of them, on hashed n-grams of words and marks, on length and
on title position, so that wordings outside the patterns are found by the words they share. The model then scores
every segment of every text, whole; a text is a case if one segment's probability reaches the threshold. Segments that
speak of such things (quoted, explained, counted) are labelled negative. Texts that are null, empty or without a word or
mark are no cases.

Bounds: the patterns are tried on all documents, in a distributed pass; at most `sample_segments` distinct positive
segments, half as many negative ones that a pattern hits but that speak of it, and twice as many others (from documents
drawn by hash, NEGATIVE_DOCUMENTS at most in expectation) are fitted, on the driver. Kept are those that occur more than
three times, then the lowest hashes, so that the choice depends neither on order nor on partitions. Hosts (sources) whose hash falls in one fifth are held out of
the training for `validate`; the threshold was set on weak labels of such unseen hosts alone.

Features are made for a whole batch of texts at once, over one array of bytes: tokens, their hashes, segments and n-grams
are array operations, without a loop over tokens.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from funweave.scratch import cut

BUCKETS = 1 << 18
THRESHOLD = 0.5
NEGATIVE_DOCUMENTS = 8_000
SEGMENT = re.compile(r"[\n\r\t\x0b\x0c]+|(?<=[.!?])\s+")

# Weak labels. Response status and error wording.
ERROR = re.compile(
    r"http status \W*\d{3}|\b[45]\d\d (?:not found|internal server|forbidden|bad gateway|service unavail|gateway time|too many req|gone\b|unauthorized)"
    r"|\"status\": ?[45]\d\d|<code>[45]\d\d|\berror [45]\d\d\b|^\W*code [45]\d\d\.|traceback \(most recent|^\W*\w+error: |nullpointerexception"
    r"|^\W*at [\w.]+\(\w+\.java:\d+\)|file \"\w+\.py\", line|failed to open stream|^\W*database error|upstream connect error"
    r"|could ?n[o']t (?:be )?(?:load|found|served|displayed|reached)|could not (?:be )?(?:load|found|served|displayed|reached)"
    r"|cannot be (?:displayed|reached|loaded|drawn|rendered)|can't find that|something went wrong|session has expired|has timed out"
    r"|please try again|^\W*try again later|checking your browser|^\W*contact the (?:administrator|help desk)|^\W*reload the page|^\W*go back to the start"
    r"|^\W*access denied|do not have permission|does not exist or (?:has|was) moved|returned an unexpected reply|unhandled exception"
    r"|down for maintenance|offline for maintenance|refused for lack of rights|too many requests|sign in to continue|failed to load|not available at the moment"
    r"|no encontrada|nao encontrada|nicht gefunden|fehler beim laden|acces refuse|erreur interne|page introuvable|^\W*check the (?:link|address)",
    re.I,
)
FILLER = re.compile(
    r"\blorem\b|\b(?:nibh|mauris|tellus|augue|viverra)\b.*\b(?:ipsum|dolor|porta|donec|vitae|risus|orci|sapien|amet|quam|erat|justo|magna)\b|asdf"
    r"|placeholder copy|dummy (?:copy|text)|sample (?:text|content)|blank text|your own (?:words|text)"
    r"|texte d'exemple|texto de ejemplo|texto de exemplo|hier steht ihr|ersetzen sie diesen|escriba aqui|edit me!"
    r"|will appear here|click here to edit|body text goes|write a few lines|delete this note",
    re.I,
)
SCRIPTS = re.compile(
    r"(?:enable|activate|allow|turn on|switch on|unblock|needs?|requires?|without|permit|aktivieren sie|active|ative|activez|blocked|disabled)\b.{0,50}"
    r"(?:java ?script|\bjs\b|script(?:s|ing| execution)?\b|active content)|(?:java ?script|\bjs\b|script(?:s|ing| execution| loading)?|active content)\b.{0,40}(?:blocked|disabled|enabled|required|to (?:load|run|work|show|continue))"
    r"|(?:does not|n[o']t) (?:run|support|permit) .{0,20}script|(?:java ?script|\bjs) est requis|activer (?:java ?script|js)|<noscript>|nur mit javascript|请启用|有効にして",
    re.I,
)
SLOT = re.compile(
    r"\{\{+[^{}]*\}\}+|\$\{[^}]*\}|#\{[^}]*\}|<%.*?%>|\{%.*?%\}|%%[\w. ]+%%|@@[\w. ]+@@|__[A-Za-z][A-Za-z_.]*__|&&[\w. ]+&&|\[% ?[\w. ]+ ?%\]|%\(\w+\)s"
    r"|[\[<{(]\s*(?:insert|your|enter|add|todo|tbd|replace|fill|type|put|choose)\b[^\]>})]*[\]>})]|(?:goes|belongs) here\b|\bTBD TBD\b|\bX{5,}\b"
    r"|\*\*\* [\w: ]+ \*\*\*|-- [\w: ]+ --|(?<!\w)\{ ?[A-Za-z_.]*\d? ?\}|\(null\)|<<[\w. ]+>>|<no value>|\(\?{3,}\)|\[object object\]"
    r"|\$[A-Za-z_][A-Za-z_. ]{3,}\$(?!\w)|[\[<{(]missing [\w. ]+[\]>})]|\[\[[\w. ]+\]\]|\[%.*?%\]|#(?:NAME|N/A|REF|VALUE)[?!]?"
    r"|to be (?:filled in|added|completed|written|supplied)\b(?=\W*[\]>})*])|\b(undefined|none|null|nan) \1\b",
    re.I,
)
# What speaks of such things: typographic quotation (two marks in plain form) and words of documentation; of errors and
# scripts also narration.
SPEAKS = re.compile(
    r"``|''|\b(?:glossary|style guide|help text|mock-up|unit test|ticket|exit code|in the settings|templates?|stands? for|denotes?|notation|syntax|modifiers?|written in|set to null|is denied by"
    r"|rejected by|was not found in|was unavailable|visitors|marked by)\b",
    re.I,
)
NARRATES = re.compile(r"\b(?:we|our|were|was (?:updated|fixed|replaced|logged|raised|repaired|set|read|counted))\b", re.I)


# A segment is tried against the patterns only if it holds one of these; they are looked for all at once.
_OPEN_WORDS = "insert your enter add todo tbd replace fill type put choose missing null".split()
HINTS = (
    "http status| not found|internal server|forbidden|bad gateway|service unavail|gateway time|too many re| gone|unauthorized|\"status\"|<code>|error 4|error 5|code 4|code 5"
    "|traceback (|error:|nullpointerexc|.java:|.py\"|failed to|database error|upstream conn|could not|couldn't|cannot be |can't find|went wrong|has expired|timed out|try again"
    "|your browser|contact the |reload the|go back to|access denied|have permission|not exist or|unexpected reply|unhandled exc|for maintenance|lack of rights|sign in to"
    "|not available at|encontrada|nicht gefunden|fehler beim|acces refuse|erreur interne|introuvable|check the "
    "|lorem|nibh|mauris|tellus|augue|viverra|asdf|placeholder c|dummy copy|dummy text|sample text|sample cont|blank text|your own |d'exemple|de ejemplo|de exemplo|hier steht"
    "|ersetzen sie|escriba aqui|edit me!|appear here|here to edit|body text goes|a few lines|delete this"
    "|javascript|java script|active content| js|scripts|scripting|script exec|script load| script |noscript|请启用|有効に"
    "|{|$|#{|<%|%%|@@|__|&&|[%|%(|goes here|belongs here|xxxxx|***|-- |<<|<no value|(??|[object|[[|#name|#n/a|#ref|#value|to be fill|to be add|to be comp|to be writ|to be supp"
    "|undefined undef|none none|null null|nan nan"
).split("|") + [x + gap + w for x in "[<{(" for gap in ("", " ") for w in _OPEN_WORDS]
REPEATS = re.compile(r"\b(\w+(?: \w+){0,2})(?: \1){3,}", re.I)
_FOREIGN = re.compile(r"[^\x00-\x7f]+")
_HIDDEN = re.compile("[\u0300-\u036f\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
_WIDE = re.compile("([\u3040-\u30ff\u3400-\u9fff])")
_LIKE = str.maketrans({"“": "``", "”": "''", "„": "``", "«": "``", "»": "''", "’": "'", "‘": "'", "–": "-", "—": "-", "…": "...", "。": ". ", "\u2028": "\n", "\u2029": "\n", "\x85": "\n"})


@lru_cache(maxsize=20_000)
def _plain_run(run: str) -> str:
    return _HIDDEN.sub("", unicodedata.normalize("NFKD", run)).translate(_LIKE)


def plain(text: str) -> str:
    """In compatibility form, without accents and invisible characters, marks in their plain form."""
    return text if text.isascii() else _FOREIGN.sub(lambda m: _plain_run(m[0]), text)


def segments(text: str | None) -> list[str]:
    """The segments of a plain text."""
    return [s for s in SEGMENT.split(text) if s and not s.isspace()] if text else []


@lru_cache(maxsize=1)
def _automaton():  # noqa: ANN202
    import ahocorasick

    found = ahocorasick.Automaton()
    for h in HINTS:
        found.add_word(h, 1)
    found.make_automaton()
    return found


def _hinted(low: str) -> bool:
    return next(_automaton().iter(low), None) is not None


def _repeats(low: str) -> bool:
    """Whether up to three words may stand four times in a row."""
    words = low.split()
    return any(sum(map(eq, words, words[p:])) >= 3 * p for p in (1, 2, 3))


def pattern_hit(segment: str) -> str | None:
    """`case` by its wording, `speaks` if it only speaks of it, None without a pattern."""
    low = segment.lower()
    wording = slot = False
    if _hinted(low):
        wording = bool(ERROR.search(segment) or FILLER.search(segment) or SCRIPTS.search(segment))
        slot = not wording and bool(SLOT.search(segment))
    if not (wording or slot or (_repeats(low) and REPEATS.search(segment))):
        return None
    return "speaks" if SPEAKS.search(segment) or (wording and NARRATES.search(segment)) else "case"


def weak_label(segment: str) -> int:
    """1 a case by its wording, else 0; what speaks of such things counts as none."""
    return int(pattern_hit(segment) == "case")


def suspect(text: str) -> bool:
    """Whether a pattern may hit one of the segments of a plain text."""
    low = text.lower()
    return _hinted(low) or _repeats(low)


# --- features of a batch of texts ------------------------------------------------------------------------------

# classes of bytes: 0 blank, 1 word, 2 mark, 3 line end
_CLASS = np.full(256, 2, np.uint8)
_CLASS[[*range(32), 32, 127]] = 0
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[[9, 10, 11, 12, 13]] = 3
_LOW = np.arange(256, dtype=np.uint64)
_LOW[65:91] += np.uint64(32)
_LOW += np.uint64(1)
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63]] = True
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_POWER = np.cumprod(np.full(64, 0x100000001B3, np.uint64), dtype=np.uint64)
_NUMBER, _STATUS, _MIXED, _CAPITALS, _SMALL, _RUN = (np.uint64(x) for x in (11, 12, 13, 14, 15, 16))
PER_TOKEN = 5


def features(texts: list[str], whole: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets (five for each token: the token, the two and three tokens that end with it within its segment, and both by
    the shapes of their words), the first bucket of each segment, and the text of each segment. `whole` texts are one segment each.

    Numbers count as one token, three digits from 400 to 599 as another; words with digits, and runs of one letter, too.
    """
    coded = [_WIDE.sub(r" \1 ", t).encode("utf-8", "replace") if not t.isascii() else t.encode() for t in texts]
    raw = np.frombuffer(b"\n".join([*coded, b""]), np.uint8)
    none = np.zeros(0, np.int64)
    ends = np.cumsum(np.array([len(c) + 1 for c in coded], np.int64)) if coded else none
    kind = _CLASS[raw]
    solid = (kind == 1) | (kind == 2)
    new = solid.copy()
    new[1:] &= (kind[1:] != kind[:-1]) | ((kind[1:] == 2) & (raw[1:] != raw[:-1]))
    start = np.flatnonzero(new)
    if not len(start):
        return none, none, none
    # a token ends where the next begins or a blank follows
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | new[1:]
    end = np.flatnonzero(stop)
    size = end - start + 1
    inside = np.flatnonzero(solid)
    first = np.cumsum(size) - size
    place = np.arange(len(inside)) - np.repeat(first, size)
    b = raw[inside]
    h = np.add.reduceat(_LOW[b] * _POWER[place & 63], first)
    digits = np.add.reduceat(_DIGIT[b].astype(np.int64), first)
    lead = raw[start]
    h = np.where(digits > 0, np.where(digits == size, np.where((size == 3) & ((lead == 52) | (lead == 53)), _STATUS, _NUMBER), _MIXED), h)
    run = (size > 4) & (digits == 0) & (np.minimum.reduceat(b, first) == np.maximum.reduceat(b, first))
    h = np.where(run, _RUN + lead.astype(np.uint64), h) * _A
    h ^= h >> np.uint64(29)
    text = np.searchsorted(ends, start, "right")
    edge = np.ones(len(start), bool)
    edge[1:] = text[1:] != text[:-1]
    title = edge.copy()
    if not whole:
        lines = np.cumsum(kind == 3)
        edge[1:] |= (lines[start[1:]] != lines[end[:-1]]) | (_STOP[raw[end[:-1]]] & (start[1:] > end[:-1] + 1))
    seg = np.flatnonzero(edge)
    count = np.diff(np.append(seg, len(start)))
    at = np.arange(len(start)) - np.repeat(seg, count)
    two, three = h.copy(), h.copy()
    two[1:] = h[1:] * _B + h[:-1]
    three[2:] = h[2:] * _B + two[1:-1] * _A
    two[at < 1] = np.uint64(1)  # an n-gram that would reach before the segment says that the segment begins here
    three[at < 2] = two[at < 2] + np.uint64(2)
    # the same with every word by its shape alone: lower case, capitals, number; marks stay as they are
    word = kind[start] == 1
    upper = np.add.reduceat(_UPPER[b].astype(np.int64), first) == size
    shape = np.where(word, np.where(digits > 0, _NUMBER, np.where(upper & (size > 1), _CAPITALS, _SMALL)) * _A, h)
    duo, trio = shape.copy(), shape.copy()
    duo[1:] = shape[1:] * _A + shape[:-1] * _B
    trio[2:] = shape[2:] * _A + duo[1:-1] * _B
    duo[at < 1] = shape[at < 1]
    trio[at < 2] = duo[at < 2]
    grams = np.stack([h, two, three, duo + np.uint64(5), trio + np.uint64(7)], axis=1) * _A
    x = (grams >> np.uint64(46)).astype(np.int64)
    # length and title position take the place of the first token's n-grams, which do not exist
    long = np.minimum(np.log2(count).astype(np.int64), 6)
    x[seg, 1] = long
    x[seg, 2] = 8 + title[seg]
    return x.ravel(), seg * PER_TOKEN, text[seg]


def fit(segs: list[str], titles: np.ndarray, labels: np.ndarray, rounds: int = 80, l2: float = 1e-6) -> np.ndarray:
    """Weights and, last, the bias of a logistic regression; both labels weigh the same in all."""
    x, at, text = features(segs, True)
    if not len(at):
        return np.append(np.zeros(BUCKETS), -30).astype(np.float32)
    x[at + 2] = 8 + titles[text]
    labels = labels[text]
    row = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(x))))
    share = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    w, b = np.zeros(BUCKETS), 0.0
    g2, gb2 = np.full(BUCKETS, 1e-12), 1e-12
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(w[x], at) + b, -30, 30)))
        e = (p - labels) * share
        g = np.bincount(x, e[row], BUCKETS) + l2 * w
        g2 += g * g
        gb2 += e.sum() ** 2
        w -= 0.3 * g / np.sqrt(g2)
        b -= 0.3 * e.sum() / np.sqrt(gb2)
    return np.append(w, b).astype(np.float32)


def score(model: np.ndarray, texts: list[str]) -> np.ndarray:
    """The highest probability of a segment of each plain text; 0 without one."""
    out = np.zeros(len(texts))
    x, at, text = features(texts)
    if len(at):
        total = np.add.reduceat(model[x], at) + model[-1]
        first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        out[text[first]] = 1 / (1 + np.exp(-np.clip(np.maximum.reduceat(total, first), -30, 30)))
    return out


def held_out() -> F.Column:
    return F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(5)) == 0


KINDS = {"case": 2, "speaks": 1, "other": 4}  # shares of sample_segments, in halves


def labelled(docs: DataFrame, sample_segments: int) -> pd.DataFrame:
    """segment (whole), first (whether it begins a text), kind: distinct segments, of each kind the most frequent ones, then the lowest hashes."""
    drawn = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, NEGATIVE_DOCUMENTS / max(1, docs.count()))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t, d in zip(b["text"], b["drawn"]):
                t = plain(t)
                may = suspect(t)
                if d or may:
                    for i, s in enumerate(segments(t)):
                        hit = pattern_hit(s) if may else None
                        if hit or d:
                            rows.append((s, i == 0, hit or "other"))
            yield pd.DataFrame(rows, columns=["segment", "first", "kind"])

    found = docs.select("text", drawn.alias("drawn")).mapInPandas(run, "segment string, first boolean, kind string")
    found = found.groupBy("kind", "segment").agg(F.min("first").alias("first"), F.count("*").alias("n")).withColumn("at", F.xxhash64("segment"))
    found = cut(found, "segments")
    out = None
    for kind, halves in KINDS.items():  # no more than the bound leaves a task
        part = found.filter(F.col("kind") == kind).orderBy(F.desc(F.greatest("n", F.lit(3))), "at", "segment").limit(sample_segments * halves // 2)
        out = part if out is None else out.union(part)
    return out.select("segment", "first", "kind").toPandas()


def train(docs: DataFrame, sample_segments: int = 8_000) -> np.ndarray:
    """A model fitted on a bounded sample of the labelled segments of all the given documents."""
    rows = labelled(docs.filter("text is not null and text <> ''"), sample_segments)
    return fit(list(rows["segment"]), rows["first"].to_numpy(bool).astype(int), (rows["kind"] == "case").to_numpy(float))


def save_model(spark: SparkSession, model: np.ndarray, path: str) -> None:
    """One row of weights; the folder must be one that all executors share."""
    spark.createDataFrame([(bytearray(model.tobytes()),)], "weights binary").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> np.ndarray:
    return np.frombuffer(spark.read.parquet(path).collect()[0][0], np.float32)


def scored(docs: DataFrame, model: np.ndarray, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, p (the highest probability of a segment, 0 without one)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one megabyte, fixed by BUCKETS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 500):
                b = whole.iloc[at : at + 500]
                yield b[list(keep)].assign(p=score(shared.value, [plain(t) if t else "" for t in b["text"]]))

    fields = ", ".join(f"{c} {dict(docs.dtypes)[c]}" for c in keep)
    return docs.select(*keep, "text").mapInPandas(run, f"{fields}, p double")


def residue(docs: DataFrame, threshold: float = THRESHOLD, model: np.ndarray | None = None) -> DataFrame:
    """doc_id of the documents with a segment that is no content, by a saved model or one fitted on these documents."""
    return scored(docs, train(docs) if model is None else model).filter(F.col("p") >= threshold).select("doc_id")


def clean(docs: DataFrame, threshold: float = THRESHOLD, model: np.ndarray | None = None) -> DataFrame:
    """The documents without the cases."""
    return docs.join(residue(docs, threshold, model), "doc_id", "left_anti")


def validate(docs: DataFrame, thresholds: tuple[float, ...] = (THRESHOLD,)) -> DataFrame:
    """A row for each threshold: documents, precision and recall against weak labels on hosts that the training has not seen."""
    model = train(docs.filter(~held_out()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "weak": [any(weak_label(s) for s in segments(plain(t))) if t else False for t in b["text"]]})

    unseen = docs.filter(held_out())
    weak = unseen.select("doc_id", "text").mapInPandas(run, "doc_id long, weak boolean")
    both = scored(unseen, model).join(weak, "doc_id").withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).withColumn("hit", F.col("p") >= F.col("threshold"))
    n = lambda c: F.count_if(c)
    return both.groupBy("threshold").agg(
        F.count("*").alias("documents"), n("weak").alias("labelled"), n("hit").alias("found"),
        F.try_divide(n(F.col("hit") & F.col("weak")), n("hit")).alias("precision"), F.try_divide(n(F.col("hit") & F.col("weak")), n("weak")).alias("recall"),
    )
