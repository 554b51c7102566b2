"""Language by Bayesian evidence fusion.

The text's likelihood comes from letter trigrams of its words, counted per language on at
most ``SAMPLE`` labelled documents (the least by a hash of the id).  It is tempered to
that of at most ``WORDS`` words, as neighbouring words are not independent.  A first
posterior from the text alone gives soft counts, and grouped aggregation turns these, over all
rows, into the other evidence: how often each declared markup language and each address
suffix goes with a language, and a prior for each host, smoothed towards its domain,
which is smoothed towards all rows.  A row's own share is taken out of its host's counts.
The product of all is the posterior.

Rows may be documents (their source stands for the host; they declare nothing) or pages.

Nulls: a null or empty text has a flat likelihood, so the other evidence decides; missing
declarations, suffixes and hosts add nothing.  A null id stays null.  Repeated rows are judged
alike.  Empty tables give empty results; without labelled documents lang is null.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logscope.llm.common import table
from logscope.llm.op7_wrappers import host_of

#: Most labelled documents that trigrams are counted on, and most trigrams kept.
SAMPLE, TRIGRAMS, WORDS = 20_000, 30_000, 40
#: Weight of a domain's prior in a host, of all rows in a domain, and in the tables.
ALPHA, BETA, KAPPA = 5.0, 20.0, 10.0
LETTERS = re.compile(r"[^\W\d_]+")
MARKUP = re.compile(r"<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*>", re.S | re.I)


def page_text(page: str | None) -> str:
    """The text of a page's markup, all of it."""
    text = MARKUP.sub(" ", page or "")
    return entities.unescape(text) if "&" in text else text


def trigrams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + 3] for i in range(len(w) - 2)]


class Letters:
    """Log-likelihoods of words in each language, by trigrams; words are remembered."""

    def __init__(self, langs: list[str], counts: dict[str, np.ndarray]):
        self.langs, self.at = langs, {t: i for i, t in enumerate(counts)}
        sums = np.array(list(counts.values())).reshape(len(counts), len(langs))
        log = np.log((sums + 0.5) / (sums.sum(0) + 0.5 * (len(counts) + 1))) if len(langs) else sums
        rare = np.log(0.5 / (sums.sum(0) + 0.5 * (len(counts) + 1))) if len(langs) else np.zeros(0)
        self.log = np.vstack([log, rare])

    def reader(self):
        """A function of a text: its tempered log-likelihoods."""
        memory, rows = {}, np.zeros((1 << 16, len(self.langs)))
        last = len(self.at)

        def row(word: str) -> int:
            nonlocal rows
            k = memory.get(word)
            if k is None:
                if len(memory) >= 300_000:
                    memory.clear()
                k = memory[word] = len(memory)
                if k >= len(rows):
                    rows = np.vstack([rows, np.zeros_like(rows)])
                rows[k] = self.log[[self.at.get(t, last) for t in trigrams(word)]].sum(0)
            return k

        def read(text: str | None) -> list[float]:
            words = LETTERS.findall((text or "").lower())
            if not words or not self.langs:
                return [0.0] * len(self.langs)
            if len(memory) + len(words) >= 300_000:
                memory.clear()
            sums = rows_of(words)
            return (sums * min(1.0, WORDS / len(words))).tolist()

        def rows_of(words: list[str]) -> np.ndarray:
            at = [row(w) for w in words]
            return rows[at].sum(0)

        return read


def fit_letters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Letters:
    """Count trigrams on a bounded sample of the labelled documents."""
    some = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    few = some.select("id").distinct().orderBy(F.xxhash64("id")).limit(SAMPLE)
    some = some.join(F.broadcast(few), "id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        sums = Counter()
        for b in batches:
            for lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for w, n in Counter(LETTERS.findall((text or "").lower())).items():
                    for t in trigrams(w):
                        sums[lang, t] += n
        yield pa.record_batch([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.string()), pa.array(list(sums.values()), pa.int64())], names=["lang", "t", "n"])

    sums = some.select("lang", "text").mapInArrow(count, "lang string, t string, n long").groupBy("t", "lang").agg(F.sum("n").alias("n"))
    best = sums.groupBy("t").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")).orderBy(F.desc("all"), "t").limit(TRIGRAMS).collect()
    # every language of the sample, however rare its trigrams
    langs = sorted(r.lang for r in some.select("lang").distinct().collect())
    return Letters(langs, {r.t: np.array([r.by.get(x, 0) for x in langs], float) for r in best})


def evidence(rows: DataFrame, letters: Letters, markup: bool) -> DataFrame:
    """``rows`` (id, host, domain, suffix, declared, text) with ll instead of text."""
    shared = rows.sparkSession.sparkContext.broadcast(letters)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = shared.value.reader()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = (t.as_py() for t in part.column(part.num_columns - 1))
                ll = [read(page_text(t) if markup else t) for t in texts]
                yield pa.record_batch([*part.columns[:-1], pa.array(ll, pa.list_(pa.float64()))], names=[*part.schema.names[:-1], "ll"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(judge, f"{kinds}, ll array<double>")


def _softmax(logs: list[Column]) -> list[Column]:
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    exps = [F.exp(x - top) for x in logs]
    total = reduce(lambda a, b: a + b, exps)
    return [e / total for e in exps]


def fuse(judged: DataFrame, langs: list[str]) -> DataFrame:
    """``judged`` with lang, p and text_lang: the likeliest language, its posterior, and the
    likeliest by the text alone."""
    if not langs:
        return judged.withColumns({"lang": F.lit(None).cast("string"), "p": F.lit(None).cast("double"), "text_lang": F.lit(None).cast("string")}).drop("ll")
    n = range(len(langs))
    rows = judged.select("*", *(p.alias(f"r{k}") for k, p in zip(n, _softmax([F.col("ll")[k] for k in n]), strict=True)))
    rows = table(rows, "judged")
    sums = lambda by, to: rows.where(F.col(by[-1]).isNotNull()).groupBy(*by).agg(*(F.sum(f"r{k}").alias(f"{to}{k}") for k in n))
    every = rows.agg(*(F.sum(f"r{k}").alias(f"g{k}") for k in n)).first()
    total = sum(every[k] or 0.0 for k in n) or 1.0
    share = [((every[k] or 0.0) + 1) / (total + len(langs)) for k in n]
    out = rows.join(sums(["kind", "domain"], "d"), ["kind", "domain"], "left").join(sums(["kind", "host"], "h"), ["kind", "host"], "left")
    out = out.join(sums(["declared"], "m"), "declared", "left").join(sums(["suffix"], "s"), "suffix", "left")
    add = lambda to: reduce(lambda a, b: a + b, [F.col(f"{to}{k}") for k in n])
    logs = []
    for k in n:
        dom = F.when(F.col("d0").isNull(), F.lit(share[k])).otherwise((F.col(f"d{k}") + BETA * share[k]) / (add("d") + BETA))
        host = F.when(F.col("h0").isNull(), dom).otherwise((F.greatest(F.col(f"h{k}") - F.col(f"r{k}"), F.lit(0.0)) + ALPHA * dom) / (F.greatest(add("h") - 1, F.lit(0.0)) + ALPHA))
        tables = F.lit(0.0)
        for to in ("m", "s"):
            part = (F.col(f"{to}{k}") + KAPPA * add(to) / total) / F.lit((every[k] or 0.0) + KAPPA)
            tables = tables + F.when(F.col(f"{to}0").isNull(), F.lit(0.0)).otherwise(F.log(part))
        logs.append(F.col("ll")[k] + F.log(host) + tables)
    posts = F.array(*(F.struct(p.alias("p"), F.lit(x).alias("lang")) for p, x in zip(_softmax(logs), langs, strict=True)))
    best = lambda items: F.reduce(items, F.struct(F.lit(-1.0).alias("p"), F.lit("").alias("lang")), lambda a, x: F.when(x["p"] > a["p"], x).otherwise(a))
    alone = best(F.array(*(F.struct(F.col(f"r{k}").alias("p"), F.lit(x).alias("lang")) for k, x in zip(n, langs, strict=True))))
    out = out.withColumn("top", best(posts)).withColumn("alone", alone)
    return out.select(*[c for c in judged.columns if c != "ll"], F.col("top.lang").alias("lang"), F.col("top.p").alias("p"), F.col("alone.lang").alias("text_lang"))


def document_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    none = F.lit(None).cast("string")
    return docs.select(F.lit("document").alias("kind"), F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("host"), none.alias("domain"), none.alias("suffix"), none.alias("declared"), F.col(text_col).alias("text"))


def page_rows(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    host = F.nullif(host_of(F.col(url_col)), F.lit(""))
    page, none = F.coalesce(F.col(html_col), F.lit("")), F.lit("")
    # of the html element, else of a content-language meta, in either order of its attributes
    tag, meta = F.regexp_extract(page, r"(?i)<html\b[^>]*", 0), F.regexp_extract(page, r"(?i)<meta\b[^>]*content-language[^>]*", 0)
    declared = F.lower(F.coalesce(F.nullif(F.regexp_extract(tag, r"(?i)\s(?:xml:)?lang\s*=\s*[\"']?([a-z]{2,8})", 1), none), F.regexp_extract(meta, r"(?i)\scontent\s*=\s*[\"']?([a-z]{2,8})", 1)))
    return pages.select(F.lit("page").alias("kind"), F.col(id_col).cast("long").alias("id"), host.alias("host"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"), F.regexp_extract(host, r"\.([^.]+)$", 1).alias("suffix"), F.nullif(declared, F.lit("")).alias("declared"), F.col(html_col).alias("text"))


def identify(docs: DataFrame | None, pages: DataFrame | None, letters: Letters) -> DataFrame:
    """kind, id, host, declared, lang, p, text_lang of documents and pages together."""
    parts = [evidence(document_rows(docs), letters, False)] if docs is not None else []
    parts += [evidence(page_rows(pages), letters, True)] if pages is not None else []
    judged = reduce(DataFrame.unionByName, parts)
    judged = judged.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in ("domain", "suffix")})
    return fuse(judged, letters.langs).select("kind", "id", "host", "declared", "lang", "p", "text_lang")
