"""Personal data: fixed patterns, and bootstrapped contextual extraction.

Fixed patterns find e-mail addresses, IP addresses, card and phone numbers; these are the base
spans.  Fixed patterns of credentials find secrets.  Both are the seeds.  A context is the two words
before a place and the word after it, however far, with digits folded, punctuation passed
over, the rest of a word beyond 24 letters as its checksum, and ^ where no word comes before.  Every occurrence of a seed
votes for its contexts; every longest run of tokens on a line that look like identifiers (they
hold a digit or @) but that no fixed pattern found is an unseen instance.  Spark joins
contexts and instances into a graph and scores it in rounds: a context is as sure of a
kind as the share of its instances that are known to be of that kind (smoothed), an
instance as sure as its best contexts together; only scores are passed on.  Contexts at
``sure`` or more with at least ``support`` distinct instances add their unseen instances as
spans of the kind.  n_<kind> counts base spans; n_secret and n_added count what the method adds.

Texts are read whole.  A text keeps one row a run of identifier-like tokens; texts without digits
and @ cost two searches.  The contexts kept at the end are those over the limits; they go
to the tasks by a join in Spark, not by the driver.

Ties: a context of two kinds with one score takes the later by name; spans at one place are listed
by kind, then end.  Very long texts: words are found once a text and looked up by place.
Nulls: a null text counts as empty, a null id stays null.  Rows are told apart by a hash of
the text, so repeated rows get the same spans.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logscope.llm.common import table

#: Kinds, in the order in which spans at one place are listed.
KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"
# Fixed patterns of credentials: a name and its value, and forms that name themselves.
_ASSIGNED = re.compile(r"(?i)(?<![a-z])(?:api|access|auth|client|private|secret)?[_-]?(?:key|token|secret|passw(?:or)?d|pwd|credential)s?[\"']?\s*[:=]\s*[\"']?([A-Za-z0-9_+/=.-]{16,})")
_SELF_NAMED = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)(?![A-Za-z0-9])")
ROUNDS, SURE, SUPPORT = 3, 0.8, 3
#: Parts into which the rows of one text are dealt where they meet what was added to it.
SALTS = 32

# Fixed patterns; possessive where a retry could not match, so long runs stay linear.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHAR = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_TOKEN = re.compile(r"\S+")
_LIKE = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[0-9]+")
#: Tokens that may stand inside a run, and what is cut off around words and runs.
_JOINS = re.compile(r"[-().+]+")
_AROUND_WORD, _AROUND_RUN = ".,;:!?\"'()[]", ".,;:!?\"'()[]<>{}#$%&*="


def luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    even = digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """A match holds one @, so each is looked at from its @ outwards."""
    after, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL_CHAR:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            after = m.end()
        else:
            after = at + 1  # no match may reach over this @
        at = text.find("@", max(after, at + 1))


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by start, then kind as listed."""
    if not text:
        return []
    found = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if _LIKE.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                found.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    found.append(("phone", *m.span()))
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0])))


def secrets(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Values of credentials, with letters and digits, that no base span touches."""
    found = {m.span(1) for m in _ASSIGNED.finditer(text)} | {m.span() for m in _SELF_NAMED.finditer(text)}
    out, upto = [], 0
    taken = sorted((s, e) for _, s, e in base)
    for s, e in sorted(found):
        value = text[s:e].rstrip(".")
        e = s + len(value)
        k = bisect_right(taken, (s, len(text)))
        free = (k == 0 or taken[k - 1][1] <= s) and (k == len(taken) or taken[k][0] >= e)
        if s >= upto and free and any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
            out.append((SECRET, s, e))
            upto = e
    return out


def _runs(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """Longest runs of tokens with a digit or @, with only spaces and lone joins between them,
    that no span touches."""
    taken = iter(sorted((s, e) for _, s, e in spans))
    hold, run, last = next(taken, None), None, 0
    for m in _TOKEN.finditer(text):
        while hold and hold[1] <= m.start():
            hold = next(taken, None)
        free = not (hold and hold[0] < m.end())
        near = run is not None and free and not text[last : m.start()].strip(" ")
        if free and _LIKE.search(m.group()):
            if run and not near:
                yield run
            run = (run[0] if near else m.start(), m.end())
        elif not near or not _JOINS.fullmatch(m.group()):
            if run:
                yield run
            run = None
        last = m.end()
    if run:
        yield run


def _named(word: str) -> str | None:
    """A word as contexts name it; null for punctuation."""
    bare = word.strip(_AROUND_WORD)
    if not any(c.isalnum() for c in bare):
        return None
    bare = _DIGITS.sub("0", bare.lower())
    return bare if len(bare) <= 24 else f"{bare[:24]}#{zlib.crc32(bare[24:].encode('utf-8', 'replace')):x}"


def occurrences(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str | None, int, int, str, str]]:
    """(kind, start, end, instance, context) of the seeds and of runs like identifiers.

    kind is null for runs, which no span touches; punctuation around them is cut off.
    """
    places = [m.span() for m in _TOKEN.finditer(text)]
    begins = [s for s, _ in places]
    named = [(k, name) for k, (s, e) in enumerate(places) if (name := _named(text[s:e]))]
    at = [k for k, _ in named]

    def words(start: int, end: int) -> str:
        # what stands before a span in its own token is a word of its own
        k = bisect_right(begins, start) - 1
        part = _named(text[begins[k] : start]) if k >= 0 and begins[k] < start else None
        n = bisect_right(at, k - 1 if k >= 0 and begins[k] <= start else k)
        before = [*(name for _, name in named[max(0, n - 2) : n]), *([part] if part else [])][-2:]
        j = bisect_right(begins, end - 1) - 1
        rest = _named(text[end : places[j][1]]) if j >= 0 and places[j][1] > end else None
        m = bisect_right(at, j)
        after = rest or (named[m][1] if m < len(named) else "")
        return "\x1f".join([*["^"] * (2 - len(before)), *before, after])

    for kind, s, e in spans:
        yield kind, s, e, text[s:e], words(s, e)
    for start, end in _runs(text, spans):
        run = text[start:end]
        s, e = start + len(run) - len(run.lstrip(_AROUND_RUN)), start + len(run.rstrip(_AROUND_RUN))
        if s >= e:
            continue
        if s > start and text[s - 1] == "(" and text.count(")", s, e) > text.count("(", s, e):
            s -= 1  # the bracket closes inside
        yield None, s, e, text[s:e], words(s, e)


def patterns(context: Column) -> Column:
    """Lexical patterns of a context: both sides, the two words before, and the word after."""
    a, b, c = (F.get(F.split(context, "\x1f"), F.lit(k)) for k in range(3))
    return F.array_compact(F.array(F.concat(b, F.lit(" _ "), c), F.concat(a, F.lit(" "), b, F.lit(" _")), F.when(c != "", F.concat(F.lit("_ "), c))))


def listed(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, then end, comma-joined."""
    order = F.array(*map(F.lit, (*KINDS, SECRET)))
    keyed = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.array_position(order, x["kind"]).alias("k"), x["end"].alias("end"), x["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(F.array_distinct(keyed)), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def find(docs: DataFrame, sure: float = SURE, support: int = SUPPORT, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_added."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spanned = lambda rows: [[dict(zip(("kind", "start", "end"), x, strict=True)) for x in s] for s in rows]
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [t.as_py() or "" for t in part.column(2)]
                like = [bool(_LIKE.search(t)) for t in texts]
                base = [base_spans(t) for t in texts]
                more = [secrets(t, s) if ok else [] for t, s, ok in zip(texts, base, like, strict=True)]
                found = [[dict(zip(("kind", "start", "end", "instance", "context"), o, strict=True)) for o in occurrences(t, [*s, *m])] if ok else [] for t, s, m, ok in zip(texts, base, more, like, strict=True)]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(spanned(base), pa.list_(span)), pa.array(spanned(more), pa.list_(span)), pa.array(found, pa.list_(occurrence))], names=["id", "row", "base", "secrets", "found"])

    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    occurrence = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.string()), ("context", pa.string())])
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("row"), F.col(text_col).alias("text"))
    kind, spans = rows.schema["id"].dataType.simpleString(), "array<struct<kind string, start long, end long>>"
    read = table(rows.mapInArrow(seeds, f"id {kind}, row long, base {spans}, secrets {spans}, found array<struct<kind string, start long, end long, instance string, context string>>"), "pii")

    # the graph: a pattern and an instance (by hash), once a text; its tables grow with the
    # documents, so they are joined by sorting, never broadcast
    once = read.where(F.size("found") > 0).dropDuplicates(["row"]).select("row", F.explode("found").alias("f")).select("row", "f.*")
    edges = table(once.select("row", "kind", "start", "end", F.xxhash64("instance").alias("instance"), F.explode(patterns(F.col("context"))).alias("pattern")), "edges")
    pairs = table(edges.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "pairs")
    known = pairs.where("kind is not null").select("instance", "kind", F.lit(1.0).alias("score")).distinct()
    belief, sizes = known, pairs.groupBy("pattern").agg(F.count("*").alias("n"))
    for _ in range(rounds):
        votes = pairs.select("pattern", "instance").join(belief.hint("merge"), "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("sum"))
        scored = votes.join(sizes.hint("merge"), "pattern").select("pattern", "kind", (F.col("sum") / (F.col("n") + 1)).alias("p"), "n")
        scored = table(scored, "patterns")
        fresh = pairs.where("kind is null").select("pattern", "instance").join(scored.where(F.col("p") >= sure / 2).hint("merge"), "pattern")
        fresh = fresh.groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least(F.col("p"), F.lit(0.999)))))).alias("score"))
        best = fresh.groupBy("instance").agg(F.max_by(F.struct("kind", "score"), F.struct("score", "kind")).alias("b")).select("instance", "b.kind", "b.score")
        belief = table(known.unionByName(best.join(known.select("instance").hint("merge"), "instance", "left_anti")), "belief")
    strong = scored.where((F.col("p") >= sure) & (F.col("n") >= support)).groupBy("pattern").agg(F.max_by("kind", F.struct("p", "kind")).alias("as_kind"))
    added = edges.where("kind is null").join(strong.hint("merge"), "pattern").groupBy("row", "start", "end").agg(F.min("as_kind").alias("kind"))
    added = added.groupBy("row").agg(F.collect_set(F.struct("kind", "start", "end")).alias("added"))

    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    # a text may be that of a third of all rows: its rows are dealt, and what was added repeated
    dealt = read.drop("found").withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    added = added.withColumn("salt", F.explode(F.array(*(F.lit(k).cast("long") for k in range(SALTS)))))
    of = dealt.join(added.hint("merge"), ["row", "salt"], "left").withColumn("added", F.coalesce("added", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")))
    method = F.concat("secrets", "added")
    n_secret = F.size(F.filter(method, lambda s: s["kind"] == SECRET)).cast("long").alias("n_secret")
    return of.select(F.col("id").alias(id_col), *map(count, KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", method)).alias("spans"), n_secret, F.size(method).cast("long").alias("n_added"))
