"""Markdown chunks, BM25, exact nearest vectors, their fusion, and keyword retrieval."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b\w+\b"), F.lit(0))


def chunk(docs: DataFrame, size: int = 400, overlap: int = 50) -> DataFrame:
    """RG1: source, doc_title, section, chunk_id, text, char_count of (source, text) rows.

    A Markdown text is cut at headings of level 1 to 4; a section's paragraphs are packed to ``size`` characters,
    each chunk beginning with the end of the one before; long paragraphs stay whole.  Chunks are numbered through
    the document.  Without a heading of level 1 the title is that of the file name.
    """

    def pack(body):
        if len(body) <= size:
            return [body]
        done, held = [], ""
        for p in filter(None, (x.strip() for x in re.split(r"\n\n+", body))):
            if held and len(held) + len(p) + 2 > size:
                done.append(held.strip())
                held = held[-overlap:].strip() + "\n\n" + p if overlap else p
            else:
                held = f"{held}\n\n{p}".strip() if held else p
        return done + [held.strip()] if held.strip() else done

    def rows_of(source, text):
        title, section, n = (source or "").replace(".md", "").replace("_", " ").title(), "Overview", 0
        for part in filter(None, map(str.strip, re.split(r"(?m)^(#{1,4} .+)$", text or ""))):
            head = re.match(r"(#{1,4}) (.+)$", part)
            if head is None:
                for c in pack(part):
                    yield source, title, section, f"{source}::{section}::{n}", c, len(c)
                    n += 1
            elif len(head[1]) == 1:
                title, section = part.lstrip("#").strip(), "Overview"
            else:
                section = part.lstrip("#").strip()

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [r for source, text in zip(pdf["source"], pdf["text"]) for r in rows_of(source, text)]
            yield pd.DataFrame(rows, columns=["source", "doc_title", "section", "chunk_id", "text", "char_count"])

    return docs.select("source", "text").mapInPandas(run, "source string, doc_title string, section string, chunk_id string, text string, char_count long")


def citation(source: str, section: str) -> Column:
    return F.concat(F.lit("[Source: "), F.col(source), F.lit(" — "), F.col(section), F.lit("]"))


def postings(docs: DataFrame, key: str) -> DataFrame:
    """key, term, tf, dl: built once, read by every query."""
    words = docs.select(key, tokens(F.coalesce("text", F.lit(""))).alias("_w")).select(key, F.size("_w").alias("dl"), F.explode("_w").alias("term"))
    return words.groupBy(key, "term", "dl").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, query: str, key: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """RG3: key, bm25 (1 for the best) of the documents that hold a word of the query."""
    sizes = docs.select(F.size(tokens(F.coalesce("text", F.lit("")))).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    words = sorted(set(re.findall(r"\w+", query.lower())))
    has = postings(docs, key).where(F.col("term").isin(*words))
    df = has.groupBy("term").agg(F.count("*").alias("df"))
    s = has.join(F.broadcast(df), "term").crossJoin(F.broadcast(sizes))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    total = s.groupBy(key).agg(F.sum(part).alias("s"))
    best = total.agg(F.max("s").alias("best"))
    return total.crossJoin(F.broadcast(best)).select(key, (F.col("s") / F.nullif("best", F.lit(0.0))).alias("bm25"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """RG2: the k rows of largest cosine to one query vector (a literal, so nothing is joined)."""
    q = F.lit([float(x) for x in query])
    norm = F.sqrt(dot(F.col(column), F.col(column))) * F.sqrt(dot(q, q))
    return vectors.select(key, (dot(F.col(column), q) / F.nullif(norm, F.lit(0.0))).alias("score")).orderBy(F.desc("score"), key).limit(k)


def hybrid(semantic: DataFrame, lexical: DataFrame, key: str, k: int, alpha: float = 0.7) -> DataFrame:
    """RG4: alpha x cosine (0 to 1) + (1 - alpha) x BM25; the k best above zero."""
    both = semantic.select(key, F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("sem")).join(lexical, key, "full")
    score = alpha * F.coalesce("sem", F.lit(0.0)) + (1 - alpha) * F.coalesce("bm25", F.lit(0.0))
    return both.select(key, score.alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(k)


def keyword(chunks: DataFrame, query: str, k: int = 3) -> DataFrame:
    """KR1: share of query words in a chunk, raised where a long word occurs or the section names one."""
    words = sorted(set(re.findall(r"\w+", query.lower())))
    q = F.array(*[F.lit(w) for w in words])
    base = F.size(F.array_intersect(F.array_distinct(tokens(F.col("text"))), q)) / len(words)
    low, section = F.lower("text"), F.lower(F.coalesce("section", F.lit("")))
    boost = F.when(F.exists(q, lambda w: (F.length(w) > 4) & low.contains(w)), 1.5).otherwise(1.0) * F.when(F.exists(q, lambda w: section.contains(w)), 1.3).otherwise(1.0)
    return chunks.withColumn("score", base * boost).where("score > 0").orderBy(F.desc("score"), "chunk_id").limit(k)
