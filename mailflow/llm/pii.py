"""Personal data: base rules plus bootstrapped contextual extraction.

The base rules find e-mail addresses, IPv4 addresses, card and phone numbers.
These entities are the seeds of the method: the words around an entity are its
lexical patterns (two words before; one word before; the words on both sides).
Spark scores the bipartite graph of patterns and instances iteratively: a
pattern's confidence for a kind is the mean score of its distinct instances
(smoothed by one), an unknown instance's score the best confidence among its
patterns. Patterns with enough distinct seeds and a high confidence accept the
identifier-like candidates found in their contexts that no base rule matched
(numbers without the country sign, checksum failures, written-out addresses);
what they accept is a weaker seed of the next round. A context is looked for in
the 80 characters before and the 40 after; numbers side by side share the words
before the first; instances are told apart by their first 64 characters.

Defined results: null counts as the empty text; offsets are code points, end
exclusive; very long texts are scanned whole in linear time; repeated rows give
equal rows; an empty table gives none; only the named columns are read.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, sized_broadcast, stored

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A match of the ip rule takes whole digit runs, so it starts and ends at their borders.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ANY = re.compile(r"[0-9@]|[\[(]at[\])]")
# Candidates of the method: long numbers with separators, four dotted numbers, written-out addresses.
NUMBER = re.compile(r"(?<![\w.+-])\(?[0-9][0-9 ().-]{5,}[0-9](?!\w)")
WRITTEN = re.compile(r"[A-Za-z0-9._-]{1,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,64}(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{1,64})+")
_DOUBLE = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[0::2]) + sum(_DOUBLE[x] for x in d[1::2])) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from the at signs in linear time."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        low = at + 1
        if m:
            out.append((start, m.end()))
            low = m.end()
        at = text.find("@", low)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base rules by kind, then start."""
    out = [("email", s, e) for s, e in _emails(text)]
    for m in IP.finditer(text):
        if all(len(x) <= 3 and int(x) <= 255 or int(x[-4:]) <= 255 and not x[:-3].strip("0") for x in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Identifier-like spans ``(shape, start, end)`` that no base span touches."""
    taken = sorted((s, e) for _, s, e in base)
    out = []
    found = [("number", m.start(), m.end()) for m in NUMBER.finditer(text)]
    if "at" in text:
        found += [("written", m.start(), m.end()) for m in WRITTEN.finditer(text)]
    for shape, s, e in found:
        for s, e in _apart(text, s, e) if shape == "number" else ((s, e),):
            if any(a < e and s < b for a, b in taken if a < e):
                continue
            kind = shape
            if shape == "number":
                n = _digits(text[s:e])
                kind = "dotted" if re.fullmatch(r"[0-9]+(\.[0-9]+){3}", text[s:e]) else "long" if n >= 13 else "short"
                if not 7 <= n <= 19:
                    continue
            out.append((kind, s, e))
    return out


def _digits(word: str) -> int:
    return sum(map(str.isdigit, word))


def _apart(text: str, s: int, e: int) -> list[tuple[int, int]]:
    """Numbers side by side one by one: the parts between blanks, if each could be a number of its own."""
    parts = [(s + m.start(), s + m.end()) for m in re.finditer("[^ ]+", text[s:e])]
    return parts if len(parts) > 1 and all(_digits(text[a:b]) >= 7 for a, b in parts) else [(s, e)]


# Which shapes a pattern of a kind may accept.
FITS = {"email": ("written",), "ip": ("dotted",), "card": ("long",), "phone": ("short", "long")}
_EDGE = ".,;:!?()[]{}\"'<>"


def contexts(text: str, s: int, e: int) -> list[str]:
    words = text[max(0, s - 80):s].split()
    while words and _digits(words[-1]) >= 7:  # of a list of numbers all have the words before the first
        words.pop()
    before = [w.strip(_EDGE).lower() for w in words[-2:]]
    after = [w.strip(_EDGE).lower() for w in text[e:e + 40].split()[:1]]
    out = ["1 " + before[-1]] if before else []
    if len(before) == 2:
        out.append("2 " + " ".join(before))
    if before and after:
        out.append("3 " + before[-1] + " _ " + after[0])
    return out


def scan_text(text: str) -> tuple[list[tuple[str, int, int]], list[str]]:
    """Base spans, and graph edges ``kind|shape, start, end, instance, pattern``."""
    if not ANY.search(text):
        return [], []
    base = base_spans(text)
    edges = []
    for kind, s, e in base + [("?" + x, s, e) for x, s, e in candidates(text, base)]:
        name = re.sub(r"[\s().+-]", "", text[s:e]).lower()[:64]
        edges += ["\x1f".join((kind, str(s), str(e), name, c)) for c in contexts(text, s, e)]
    return base, edges


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Base results per row with a row id and the edges of the graph; written once."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for b in batches:
            rows = [scan_text("" if pd.isna(t) else t) for t in b["text"]]
            out = b[keep].copy()
            out["base"] = [_joined(x) for x, _ in rows]
            for k in KINDS:
                out["n_" + k] = [sum(s[0] == k for s in x) for x, _ in rows]
            out["edges"] = [e for _, e in rows]
            yield out

    text = [] if "text" in keep else ["text"]
    got = docs.select(*keep, *text).mapInPandas(
        run, schema + ", base string, " + ", ".join(f"n_{k} long" for k in KINDS) + ", edges array<string>")
    return stored(got.withColumn("rid", F.monotonically_increasing_id()), "pii")


def occurrences(scanned: DataFrame) -> DataFrame:
    x = (scanned.where(F.size("edges") > 0).select("rid", F.explode("edges").alias("e"))
         .select("rid", F.split("e", "\x1f").alias("e")))
    return x.select("rid", F.col("e")[0].alias("kind"), F.col("e")[1].cast("long").alias("start"),
                    F.col("e")[2].cast("long").alias("end"), F.col("e")[3].alias("instance"),
                    F.col("e")[4].alias("pattern"))


SURE = 0.9  # score of an instance found by an accepted pattern: a seed like those of the base rules, but weaker


def patterns(occ: DataFrame, rounds: int = 8, least: float = 0.8, seeds: int = 5) -> DataFrame:
    """Confident ``(pattern, kind)`` by iterative scoring of the pattern-instance graph.

    ``seeds``: distinct seed instances a pattern needs; one-word patterns need
    twice as many. What an accepted pattern finds is a seed of the next round,
    until neither the accepted patterns nor the confidences change (or ``rounds`` are over).
    """
    edge = cut(occ.groupBy("pattern", "instance").agg(
        F.min(F.when(~F.col("kind").startswith("?"), F.col("kind"))).alias("seed")))
    known = edge.where("seed is not null").select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct()
    members = edge.groupBy("pattern").agg(F.count("*").alias("members"))
    need = F.when(F.col("pattern").startswith("1 "), 2 * seeds).otherwise(seeds)
    score, before = known, None
    for _ in range(rounds):
        conf = (edge.select("pattern", "instance").join(score, "instance")
                .groupBy("pattern", "kind").agg(F.sum("score").alias("mass"),
                                                F.sum((F.col("score") >= SURE).cast("int")).alias("n_seeds"))
                .join(members, "pattern").withColumn("conf", F.col("mass") / (F.col("members") + 1)))
        conf = cut(conf.where(F.col("conf") >= 0.3).withColumn("accepted", (F.col("conf") >= least) & (F.col("n_seeds") >= need)))
        now = conf.agg(F.count(F.when(F.col("accepted"), 1)), F.round(F.sum("conf"), 1)).first()
        if now == before:
            break
        before = now
        worth = F.when(F.col("accepted"), F.lit(SURE)).otherwise(F.least(F.col("conf"), F.lit(SURE - 0.01)))
        fresh = (edge.where("seed is null").select("pattern", "instance").join(conf.withColumn("worth", worth), "pattern")
                 .groupBy("instance", "kind").agg(F.max("worth").alias("score"))
                 .join(known.select("instance"), "instance", "left_anti"))
        score = cut(known.unionByName(fresh))
    return conf.where("accepted").select("pattern", F.col("kind").alias("as_kind"))


def discovered(occ: DataFrame, confident: DataFrame) -> DataFrame:
    """Accepted candidate spans per row id: ``rid, more`` (array of kind:start:end)."""
    fits = F.lit(False)
    for kind, shapes in FITS.items():
        fits = fits | ((F.col("as_kind") == kind) & F.col("kind").isin(*["?" + s for s in shapes]))
    hit = (occ.where(F.col("kind").startswith("?")).join(confident, "pattern").where(fits)
           .groupBy("rid", "start", "end").agg(F.min("as_kind").alias("as_kind")))
    return hit.groupBy("rid").agg(F.collect_list(F.concat_ws(":", "as_kind", "start", "end")).alias("more"))


def _merge(base: str, more) -> str:
    if more is None or len(more) == 0:
        return base
    split = lambda x: (lambda p: (p[0], int(p[1]), int(p[2])))(x.split(":"))
    return _joined({split(x) for x in [*filter(None, base.split(",")), *more]})


def _searched(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with ``n_*``, ``base`` and the accepted candidates ``more`` (null: none)."""
    scanned = scan(docs, keep)
    occ = occurrences(scanned)
    more = cut(discovered(occ, patterns(occ)))
    return scanned.drop("edges").join(sized_broadcast(more, 20_000), "rid", "left").drop("rid")


def find(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with ``n_*`` and ``base`` of the base rules and ``spans`` of the method."""
    rows = _searched(docs, keep)
    plain = rows.where("more is null").withColumn("spans", F.col("base")).drop("more")
    schema = plain.schema

    def run(batches):
        for b in batches:
            b["spans"] = [_merge(x, m) for x, m in zip(b["base"], b["more"])]
            yield b[[f.name for f in schema]]

    return plain.unionByName(rows.where("more is not null").mapInPandas(run, schema))


def redact_text(text: str, spans: str) -> str:
    """Spans replaced by their kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for s, e, kind in sorted((int(x.split(":")[1]), int(x.split(":")[2]), x.split(":")[0]) for x in spans.split(",") if x):
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], f"<{kind}>"]
        at = e
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """The same columns, with the personal data in ``text`` replaced."""
    cols = docs.columns
    rows = _searched(docs, cols)
    schema = docs.schema

    def run(batches):
        for b in batches:
            spans = [_merge(x, m) for x, m in zip(b["base"], b["more"])]
            b["text"] = [t if pd.isna(t) else redact_text(t, s) for t, s in zip(b["text"], spans)]
            if "n_chars" in cols:
                b["n_chars"] = [n if pd.isna(t) else len(t) for n, t in zip(b["n_chars"], b["text"])]
            yield b[cols]

    dirty = (F.col("base") != "") | F.col("more").isNotNull()
    return (rows.where(~dirty).select(*cols)
            .unionByName(rows.where(dirty).select(*cols, "base", "more").mapInPandas(run, schema)))


def op8(documents: DataFrame) -> DataFrame:
    """Contract query over every whole text."""
    return find(documents.select("doc_id", "text"), ["doc_id"]).select(
        "doc_id", *[f"n_{k}" for k in KINDS], F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
