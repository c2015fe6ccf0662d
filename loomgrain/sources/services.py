"""Parsers of what services answer: token streams, model catalogues and web results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ndjson_tokens(bodies: DataFrame, body: str = "body") -> DataFrame:
    """(seq, token) of each JSON line with a message content; lines that don't parse are left out.

    The whole body is split by line ends, so lines cut by network chunks are whole again.
    """
    split = bodies.select(*[c for c in bodies.columns if c != body], F.posexplode(F.split(body, r"\r?\n")).alias("seq", "line"))
    return split.withColumn("token", F.get_json_object("line", "$.message.content")).where("token IS NOT NULL AND token <> ''").drop("line")


def sse_tokens(bodies: DataFrame, body: str = "body") -> DataFrame:
    """(seq, token) of each ``data:`` line before the end mark."""
    data = F.transform(F.filter(F.split(body, r"\r?\n"), lambda x: x.startswith("data: ")), lambda x: F.substring(x, 7, 2**30))
    stop = F.array_position(data, F.lit("[DONE]"))
    open_part = F.when(stop > 0, F.slice(data, F.lit(1), F.greatest(stop - 1, F.lit(0)).cast("int"))).otherwise(data)
    split = bodies.select(*[c for c in bodies.columns if c != body], F.posexplode(open_part).alias("seq", "line"))
    return split.withColumn("token", F.get_json_object("line", "$.choices[0].delta.content")).where("token IS NOT NULL AND token <> ''").drop("line")


def model_groups(bodies: DataFrame, body: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, name, tier) after the columns ``keep``: catalogue models, free where the prompt price is "0"; a missing price counts as paid."""
    rows = F.from_json(F.get_json_object(body, "$.data"), "array<struct<id: string, name: string, pricing: struct<prompt: string>>>")
    tier = F.when(F.col("m.pricing.prompt") == "0", "free").otherwise("paid")
    return bodies.select(*keep, F.explode(rows).alias("m")).where("m.id IS NOT NULL").select(*keep, "m.id", F.coalesce("m.name", "m.id").alias("name"), tier.alias("tier"))


def local_models(bodies: DataFrame, body: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    """(name) of a local server's models, after the columns ``keep``."""
    rows = F.from_json(F.get_json_object(body, "$.models"), "array<struct<name: string>>")
    return bodies.select(*keep, F.explode(rows).alias("m")).select(*keep, "m.name").where("name IS NOT NULL")


def web_results(bodies: DataFrame, provider: Column | str = "provider", body: str = "body", most: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """(provider, rank, title, url, snippet) after the columns ``keep``: at most five results of each answer, those without title or url left out.

    The provider ``tavily`` has its rows in results and snippets of 500 characters
    from content; ``serper`` in organic with snippet and link. Others give nothing.
    """
    kind = F.col(provider) if isinstance(provider, str) else provider
    a = F.from_json(F.get_json_object(body, "$.results"), "array<struct<title: string, url: string, content: string>>")
    b = F.from_json(F.get_json_object(body, "$.organic"), "array<struct<title: string, link: string, snippet: string>>")
    row = lambda title, url, text: F.struct(title.alias("title"), url.alias("url"), F.coalesce(text, F.lit("")).alias("snippet"))
    rows = F.when(kind == "tavily", F.transform(a, lambda r: row(r["title"], r["url"], F.substring(r["content"], 1, 500)))).when(
        kind == "serper", F.transform(b, lambda r: row(r["title"], r["link"], r["snippet"]))
    )
    return bodies.select(*keep, kind.alias("provider"), F.posexplode(F.slice(rows, 1, most)).alias("rank", "r")).where("r.title IS NOT NULL AND r.url IS NOT NULL").select(*keep, "provider", "rank", "r.*")


def pull_progress(bodies: DataFrame, body: str = "body") -> DataFrame:
    """(seq, status, percent, done) of each ``data:`` line while a model is fetched; lines that don't parse and what follows success are left out.

    The percentage is rounded, 0 where no total is known, 100 on success.
    """
    data = F.transform(F.filter(F.split(body, r"\r?\n"), lambda x: x.startswith("data:")), lambda x: F.trim(F.substring(x, 6, 2**30)))
    read = F.transform(data, lambda x: F.from_json(x, "status string, total double, completed double"))
    known = F.filter(read, lambda r: r["status"].isNotNull() | r["total"].isNotNull())
    stop = F.array_position(F.transform(known, lambda r: F.coalesce(r["status"], F.lit(""))), F.lit("success")).cast("int")
    kept = F.when(stop > 0, F.slice(known, F.lit(1), stop)).otherwise(known)
    done = F.col("r.status") == "success"
    share = F.when(F.col("r.total") > 0, F.floor(100 * F.coalesce("r.completed", F.lit(0.0)) / F.col("r.total") + 0.5)).otherwise(0)
    rows = bodies.select(*[c for c in bodies.columns if c != body], F.posexplode(kept).alias("seq", "r"))
    status = F.coalesce("r.status", F.lit("Downloading"))
    return rows.select(*[c for c in rows.columns if c != "r"], status.alias("status"), F.when(done, 100).otherwise(share).cast("int").alias("percent"), F.coalesce(done, F.lit(False)).alias("done"))
