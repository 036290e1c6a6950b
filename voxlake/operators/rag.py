"""Prompt and answer assembly for questions over retrieved chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fixed, mmss, round_even

#: Labels and messages of a prompt, by language.
LABELS_OF = {"en": ("Excerpt", "Episode", "Time", "Content"), "pt_br": ("Trecho", "Episódio", "Tempo", "Conteúdo")}
NO_CONTEXT_OF = {"en": "No relevant excerpts found.", "pt_br": "Nenhum trecho relevante encontrado."}
FRAME_OF = {"en": ("Available excerpts:\n\n", "\n\nQuestion: "), "pt_br": ("Trechos disponíveis:\n\n", "\n\nPergunta: ")}
LABELS = LABELS_OF["en"]
NO_JUDGE_CONTEXT = "(no context retrieved)"


def context_block(number: Column, title: Column, start: Column, text: Column, labels: tuple[str, str, str, str] = LABELS) -> Column:
    """Four labelled lines, each ended by a line break."""
    excerpt, episode, time, content = labels
    return F.concat(F.lit(f"[{excerpt} "), number.cast("string"), F.lit(f"]\n{episode}: "), title, F.lit(f"\n{time}: "), mmss(start), F.lit(f"\n{content}: "), text, F.lit("\n"))


def contexts(chunks: DataFrame, labels: tuple[str, str, str, str] = LABELS) -> DataFrame:
    """``query_id, context`` from ``query_id, rank, episode_title, start_time, text``: the
    chunks in rank order, numbered by place from 1, whatever ranks are missing."""
    parts = F.array_sort(F.collect_list(F.struct("rank", F.struct("episode_title", "start_time", "text").alias("c"))))
    blocks = F.transform(F.col("parts"), lambda p, i: context_block(i + 1, p["c"]["episode_title"], p["c"]["start_time"], p["c"]["text"], labels))
    return chunks.groupBy("query_id").agg(parts.alias("parts")).select("query_id", F.array_join(blocks, "\n---\n").alias("context"))


def user_prompt(context: Column, query: Column, language: str = "en") -> Column:
    head, asked = FRAME_OF[language]
    return F.concat(F.lit(head), F.coalesce(context, F.lit(NO_CONTEXT_OF[language])), F.lit(asked), query)


def judge_prompt(question: Column, chunks: Column, answer: Column, reference: Column) -> Column:
    """The judge's message; chunks are numbered from 1."""
    numbered = F.array_join(F.transform(chunks, lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), t)), "\n\n")
    context = F.when(F.size(chunks) > 0, numbered).otherwise(NO_JUDGE_CONTEXT)
    return F.concat(F.lit("QUESTION:\n"), question, F.lit("\n\nCONTEXT:\n"), context, F.lit("\n\nANSWER:\n"), answer, F.lit("\n\nREFERENCE_ANSWER:\n"), reference)


def extractive(prompt: Column, first_text: Column) -> Column:
    """Default generator: quote the first chunk."""
    return F.concat(F.substring(first_text, 1, 200), F.lit(" [Excerpt 1]"))


def answers(queries: DataFrame, chunks: DataFrame, min_similarity: float = 0.5, generate: Callable[[Column, Column], Column] = extractive, refusal: str = "No relevant excerpts were found.", language: str = "en") -> DataFrame:
    """``query_id, answer, sources, chunks_used, context_chunks`` for every query
    (``query_id, query``).

    ``chunks`` holds the top-k (``query_id, rank, similarity, episode_id, chunk_index,
    episode_title, start_time, text``); those under the floor are dropped, and a query
    without any gets the refusal.  Sources name each chunk once, in rank order."""
    kept = chunks.filter(F.col("similarity") >= min_similarity)
    once = Window.partitionBy("query_id", "episode_id", "chunk_index").orderBy("rank")
    unique = kept.withColumn("seen", F.row_number().over(once)).filter("seen = 1")
    source = F.concat_ws("|", "episode_title", mmss(F.col("start_time")), fixed(round_even("similarity", 3), 3))
    listed = unique.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", source.alias("s")))).alias("l"))
    listed = listed.select("query_id", F.array_join(F.transform("l", lambda x: x["s"]), "; ").alias("sources"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"])
    used = kept.groupBy("query_id").agg(F.count("*").alias("chunks_used"), F.min_by("text", "rank").alias("first_text"), texts.alias("context_chunks"))
    joined = queries.join(contexts(kept, LABELS_OF[language]), "query_id", "left").join(used, "query_id", "left").join(listed, "query_id", "left")
    answer = F.when(F.col("chunks_used").isNotNull(), generate(user_prompt(F.col("context"), F.col("query"), language), F.col("first_text"))).otherwise(refusal)
    return joined.select("query_id", answer.alias("answer"), F.coalesce("sources", F.lit("")).alias("sources"), F.coalesce("chunks_used", F.lit(0)).alias("chunks_used"), F.coalesce("context_chunks", F.array().cast("array<string>")).alias("context_chunks"))


def parse_judge(raw: Column) -> Column:
    """``faithfulness, answer_relevancy, answer_correctness, reasoning, error`` of a
    judge's reply; code fences are dropped.  Instead of raising, a broken reply has nulls
    and says in ``error`` what is wrong: invalid JSON, a missing or out-of-range score."""
    fields = ("faithfulness", "answer_relevancy", "answer_correctness")
    trimmed = F.trim(raw)
    body = F.when(trimmed.startswith("```"), F.regexp_replace(trimmed, r"(?m)^\s*```.*$\n?", "")).otherwise(trimmed)
    # The parser stops at the end of the first value, so what follows it is looked at here.
    bare = F.regexp_replace(body, r'"(?:[^"\\]|\\.)*"', '""')
    known = F.try_parse_json(body).isNotNull() & bare.rlike(r"^\s*\{(?:[^{}]|\{[^{}]*\})*\}\s*$")
    values = [F.get_json_object(body, f"$.{f}").try_cast("int") for f in fields]
    problems = [F.when(v.isNull(), F.lit(f"missing {f}")).when(~v.between(1, 5), F.lit(f"{f} out of range")) for f, v in zip(fields, values)]
    error = F.when(~F.coalesce(known, F.lit(False)), F.lit("invalid json")).otherwise(F.coalesce(*problems))
    keep = lambda c: F.when(error.isNull(), c)
    return F.struct(*[keep(v).alias(f) for f, v in zip(fields, values)], keep(F.coalesce(F.get_json_object(body, "$.reasoning"), F.lit(""))).alias("reasoning"), error.alias("error"))


def result_line(index: Column, title: Column, start: Column, similarity: Column, text: Column) -> Column:
    """One search result for display, its text cut to 300 characters."""
    return F.concat(F.lit("["), index.cast("string"), F.lit("] "), title, F.lit(" @ "), mmss(start), F.lit(" (similarity: "), fixed(similarity, 3), F.lit(")\n    "), F.substring(text, 1, 300))
