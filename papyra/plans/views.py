"""Fixture views over the stored tables (the inputs of the registered queries).

Each view is derived from the given tables by Spark, so every query's work
grows with the data. The same definitions are restated in DuckDB SQL in
``papyra.plans.oracle`` for the correctness gate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra import DEFAULT_MODELS
from papyra.functions.text import py_strip, tokens
from papyra.functions.models import model_array
from papyra.sources.readers import read_table


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw-article records from ``documents``.

    Line 1 is the title; with more than two lines, line 2 is the teaser and
    the rest the body paragraphs; otherwise no teaser and lines 2.. as body.
    """
    d = read_table(spark, sf_dir, "documents", "doc_id", "text")
    # split once; later expressions read the projected array
    d = d.select("doc_id", F.split(F.col("text"), "\n").alias("lines"))
    lines = F.col("lines")
    n = F.size(lines)
    return d.select(
        F.col("doc_id").alias("idx"),
        F.col("doc_id").cast("string").alias("article_id"),
        F.element_at(lines, 1).alias("title"),
        F.when(n > 2, F.element_at(lines, 2)).alias("teaser"),
        F.when(n > 2, F.slice(lines, 3, n)).when(n == 2, F.slice(lines, 2, 1))
         .otherwise(F.array().cast("array<string>")).alias("text"),
    )


def raw_article_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw-article JSON lines from ``documents`` with the reference's union-typed body.

    More than two lines: ``text`` is a list of paragraphs; exactly two: the
    second line as a plain string; one line: ``null``.
    """
    d = read_table(spark, sf_dir, "documents", "doc_id", "text")
    d = d.select("doc_id", F.split(F.col("text"), "\n").alias("lines"))   # split once
    lines = F.col("lines")
    n = F.size(lines)
    head = F.to_json(F.struct(
        F.col("doc_id").alias("idx"),
        F.element_at(lines, 1).alias("title"),
        F.col("doc_id").cast("string").alias("article_id"),
        F.concat(F.lit("/article/"), F.col("doc_id").cast("string")).alias("url"),
        F.when(n > 2, F.element_at(lines, 2)).alias("teaser"),
    ), {"ignoreNullFields": "false"})
    text_json = (F.when(n > 2, F.to_json(F.slice(lines, 3, n)))
                 .when(n == 2, F.regexp_replace(F.to_json(F.array(F.element_at(lines, 2))), "^\\[|\\]$", ""))
                 .otherwise(F.lit("null")))
    return d.select(F.concat(F.regexp_replace(head, "\\}$", ""),
                             F.lit(",\"text\":"), text_json, F.lit("}")).alias("value"))


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``d.M.yyyy``-style date strings from ``events.ts`` (day zero-padded)."""
    e = read_table(spark, sf_dir, "events", "event_id", "ts")
    txt = F.concat(F.lpad(F.dayofmonth("ts").cast("string"), 2, "0"), F.lit("."),
                   F.month("ts").cast("string"), F.lit("."), F.year("ts").cast("string"))
    return e.select("event_id", txt.alias("date_text"))


def qna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q&A pairs: a user turn followed by an assistant turn in the same conversation."""
    c = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return u.join(a, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "question", "answer")


def predictions(spark: SparkSession, sf_dir: str, models=DEFAULT_MODELS) -> DataFrame:
    """Stand-in generated outputs, one per (model, Q&A pair).

    ``full_text`` = ``Q: q\\nA: `` + (base: the question echoed; FT_full: the
    answer; FT-M1B: the answer's words in reverse order) + ``\\nQ: next``. FT-M1B
    has no output for every seventh question.
    """
    q = qna(spark, sf_dir)
    g = q.select("id", "question", "answer", F.explode(model_array(models)).alias("m")) \
        .select("id", "question", "answer", "m.model", "m.model_pos")
    reverse = F.array_join(F.reverse(F.split("answer", " ")), " ")
    body = (F.when(F.col("model_pos") == 0, F.col("question"))
            .when(F.col("model_pos") == 1, F.col("answer"))
            .otherwise(reverse))
    full = F.concat(F.lit("Q: "), F.col("question"), F.lit("\nA: "), body, F.lit("\nQ: next"))
    return g.where((F.col("model_pos") != 2) | (F.col("id") % 7 != 3)).select("model", "id", full.alias("full_text"))


def token_vectors(texts: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(tok, embedding) of every token of ``texts`` (text): stored vector number md5(token) mod their count."""
    n = embeddings.count()
    found = texts.select(F.explode(tokens(F.col("text"))).alias("tok")).distinct()
    number = F.conv(F.substring(F.md5("tok"), 1, 8), 16, 10).cast("bigint") % F.lit(n)
    return found.withColumn("vec_id", number).join(embeddings.select("vec_id", "embedding"), "vec_id").select(
        "tok", "embedding")


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt lines from ``benchmark``: every line of every item, stripped, blanks kept,
    in order (``prompt_pos`` = item, ``line_no`` = line within the item)."""
    b = read_table(spark, sf_dir, "benchmark", "item_id", "text")
    lines = b.select("item_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select(F.col("item_id").alias("prompt_pos"), F.col("line_no").cast("bigint").alias("line_no"),
                        py_strip(F.col("line")).alias("prompt"))


def generations(spark: SparkSession, sf_dir: str, models=DEFAULT_MODELS) -> DataFrame:
    """Stand-in generations per (prompt line, model): the prompt line followed by the
    next ``model_pos`` lines of its item."""
    b = read_table(spark, sf_dir, "benchmark", "item_id", "text").select(
        "item_id", F.split("text", "\n").alias("lines"))
    g = b.select("item_id", "lines", F.posexplode("lines").alias("line_no", "line"),
                 F.explode(model_array(models)).alias("m"))
    return g.select(F.col("item_id").alias("prompt_pos"), F.col("line_no").cast("bigint").alias("line_no"),
                    "m.model",
                    F.array_join(F.slice("lines", F.col("line_no") + 1, (F.col("m.model_pos") + 1).cast("int")),
                                 " ").alias("gen_text"))


def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss history: model = event type, step = day; mean value of odd events (train) and of even ones (eval)."""
    e = read_table(spark, sf_dir, "events", "event_id", "ts", "event_type", "value")
    return (e.groupBy(F.col("event_type").alias("model"), F.dayofmonth("ts").cast("bigint").alias("step"))
            .agg(F.round(F.avg(F.when(F.col("event_id") % 2 == 1, F.col("value"))), 6).alias("loss"),
                 F.round(F.avg(F.when(F.col("event_id") % 2 == 0, F.col("value"))), 6).alias("eval_loss")))


def training_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History files as a trainer leaves them: (model, checkpoint, value), ``value`` being the file's JSON.

    Model = event type. Day d logs train figures at step 20 d, every fourth day also an evaluation at step 20 d + 7, and
    a closing record holds run time, flops, mean loss, a metric that no schema knows and a note. A first checkpoint
    repeats the records up to day 15.
    """
    e = read_table(spark, sf_dir, "events", "event_id", "ts", "event_type", "value")
    odd = F.col("event_id") % 2 == 1
    day = (e.groupBy(F.col("event_type").alias("model"), F.dayofmonth("ts").cast("bigint").alias("d"))
           .agg(F.round(F.avg(F.when(odd, F.col("value"))), 6).alias("loss"),
                F.round(F.avg(F.when(~odd, F.col("value"))), 6).alias("eval_loss"),
                F.count(F.lit(1)).alias("n"), F.sum("value").alias("v")))
    names = ["loss", "learning_rate", "eval_loss", "eval_samples_per_second", "train_runtime", "total_flos", "train_loss",
             "custom_skips", "note"]

    def record(step, **values):
        kind = lambda m: "string" if m == "note" else "double"
        return F.struct(step.alias("step"), (step / 200).alias("epoch"),
                        *[values.get(m, F.lit(None)).cast(kind(m)).alias(m) for m in names])

    d, n = F.col("d"), F.col("n")
    train = record(20 * d, loss=F.col("loss"), learning_rate=F.round(1 / d, 6))
    ev = record(20 * d + 7, eval_loss=F.col("eval_loss"), eval_samples_per_second=n)
    daily = day.select("model", F.explode(F.when(d % 4 == 0, F.array(train, ev)).otherwise(F.array(train))).alias("r"))
    closing = day.groupBy("model").agg(F.max("d").alias("d"), F.sum("n").alias("n"), F.sum("v").alias("v"), F.count("d").alias("k"))
    closing = closing.select("model", record(
        20 * d + 7, train_runtime=n, total_flos=n * 1_000_000, train_loss=F.round(F.col("v") / n, 6),
        custom_skips=F.col("k"), note=F.lit("done")).alias("r"))
    records = daily.unionByName(closing)
    files = records.withColumn("checkpoint", F.lit(9999)).unionByName(
        daily.where(F.col("r.step") <= 307).withColumn("checkpoint", F.lit(307)))
    listed = files.groupBy("model", "checkpoint").agg(F.sort_array(F.collect_list("r")).alias("log_history"))
    return listed.select("model", "checkpoint", F.to_json(F.struct(
        "log_history", F.col("checkpoint").alias("global_step"))).alias("value"))


def step_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines of steps that report their seconds and counts, from ``events``: (run, line_no, value).

    Every fourth event of a user group starts, scrolls, finishes with a time or reports a count; a month is a run, the
    event type the component, the event's number its place in the log.
    """
    e = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    n = F.col("user_id").cast("string")
    seconds = F.format_string("%.2f", "value")
    # The forms of the messages of a run log
    say = (F.when(F.col("event_id") % 4 == 0, F.lit("Start crawling articles..."))
           .when(F.col("event_id") % 4 == 1, F.concat(F.lit("Total loaded articles: "), n))
           .when(F.col("event_id") % 4 == 2, F.concat(F.lit("Finished scrolling after "), seconds, F.lit(" seconds.")))
           .otherwise(F.concat(F.lit("Omitted "), n, F.lit(" articles with empty text."))))
    value = F.concat(F.lit("["), F.date_format("ts", LOG_TS), F.lit("] ["), _centre(F.lit("INFO"), LEVEL_WIDTH),
                     F.lit("] ["), _centre(F.col("event_type"), COMPONENT_WIDTH), F.lit("] "), say)
    return e.select(F.date_format("ts", "yyyy-MM").alias("run"), F.col("event_id").alias("line_no"), value.alias("value"))


# The log line layout (timestamp, centred level and component).
LOG_TS = "yyyy-MM-dd HH:mm:ss"
LEVEL_WIDTH, COMPONENT_WIDTH = 7, 20


def _centre(c, width):
    n = F.length(c)
    left = F.floor((F.lit(width) - n) / 2).cast("int")
    right = (F.lit(width) - n - left).cast("int")
    return F.concat(F.repeat(F.lit(" "), F.greatest(left, F.lit(0))), c,
                    F.repeat(F.lit(" "), F.greatest(right, F.lit(0))))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-log text derived from ``events``: one line per event, a continuation
    line after events with value > 45; depth = user_id % 3 (two spaces per level); a month is a run."""
    e = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    level = (F.when(F.col("event_type") == "error", "ERROR")
             .when(F.col("event_type") == "signup", "WARNING").otherwise("INFO"))
    msg = F.format_string("%s value=%.2f user=%d", F.col("event_type"), F.col("value"), F.col("user_id"))
    head = F.concat(F.lit("["), F.date_format("ts", LOG_TS), F.lit("] ["), _centre(level, LEVEL_WIDTH),
                    F.lit("] ["), _centre(F.col("event_type"), COMPONENT_WIDTH), F.lit("] "),
                    F.repeat(F.lit("  "), (F.col("user_id") % 3).cast("int")), msg)
    cont = F.concat(F.lit("    props: "), F.col("props"))
    lines = F.when(F.col("value") > 45,
                   F.array(F.struct(F.lit(0).alias("k"), head.alias("v")),
                           F.struct(F.lit(1).alias("k"), cont.alias("v")))) \
        .otherwise(F.array(F.struct(F.lit(0).alias("k"), head.alias("v"))))
    return e.select("event_id", F.date_format("ts", "yyyy-MM").alias("run"), F.explode(lines).alias("l")).select(
        "run", (F.col("event_id") * 2 + F.col("l.k")).alias("line_no"), F.col("l.v").alias("value"))


def press_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` with article markup added by rule: teaser (with a nested element), category and date at the head of
    the body; every fourth page loses its paragraph tags."""
    p = read_table(spark, sf_dir, "pages", "page_id", "url", "html")
    n = F.col("page_id").cast("string")
    head = F.concat(F.lit('<article><div class="lead teaser">No. <div>'), n, F.lit("</div> in&nbsp;short &#8211; &euro;</div>"
                    "<span class='category'>c"), (F.col("page_id") % 7).cast("string"), F.lit("</span><time>"),
                    F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"), F.lit(".03.2024</time>"))
    marked = F.replace(F.col("html"), F.lit("<article>"), head)
    bare = F.regexp_replace(marked, "(?i)</?p(\\s[^>]*)?>", " ")
    return p.select("page_id", "url", F.when(F.col("page_id") % 4 == 3, bare).otherwise(marked).alias("html"))


def newsfeed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing pages in the press layout, put by rule before each page's own markup.

    A page lists 2 + page_id % 3 entries, numbered from 1 (id = 10 page_id + number). Every fourth has no link, every
    second holds an unrelated nested article, every third a nested entry of its own.
    """
    p = read_table(spark, sf_dir, "pages", "page_id", "url", "html")
    text = lambda c: c.cast("string")

    def entry(i):
        key = text(F.col("page_id") * 10 + i)
        link = F.concat(F.lit('<h3><a href="/news/'), key, F.lit('">News '), key, F.lit("</a></h3>"))
        aside = F.when(i % 2 == 0, F.lit('<article class="note"><p>aside</p></article>')).otherwise("")
        more = F.when(i % 3 == 0, F.concat(
            F.lit("<article class='newsfeed' data-id='"), key, F.lit("n'><div class='text'><h3><a href='more/"), key,
            F.lit("'>More "), key, F.lit("</a></h3></div></article>"))).otherwise("")
        return F.concat(F.lit('<article class="newsfeed item" data-id="'), key, F.lit('"><div class="text">'),
                        F.when(i % 4 == 0, F.lit("none")).otherwise(link), F.lit("</div>"), aside, more, F.lit("</article>\n"))

    n = (2 + F.col("page_id") % 3).cast("int")
    entries = F.array_join(F.transform(F.sequence(F.lit(1), n), entry), "")
    return p.select("page_id", "url", F.concat(F.lit("</article>"), entries, F.col("html")).alias("html"))


def newsroom_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article pages in the press layout, put by rule before each page's own markup: ``.article-info`` with category and
    date, ``.teaser.clear``, and ``#article-text`` with nested boxes; every fifth page has no date."""
    p = read_table(spark, sf_dir, "pages", "page_id", "url", "html")
    n = F.col("page_id").cast("string")
    day = F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0")
    head = F.concat(
        F.lit("<h1>Press "), n, F.lit("</h1><span class='category'>menu</span><div class='article-info'><span class='category'>c"),
        (F.col("page_id") % 7).cast("string"), F.lit("</span>"),
        F.when(F.col("page_id") % 5 == 0, "").otherwise(F.concat(F.lit("<div class='date'>"), day, F.lit(".11.2025</div>"))),
        F.lit("</div><div class='clear teaser'>+++ Short "), n, F.lit(" +++</div><div id='article-text'><div class='box'><p>Box "), n,
        F.lit("</p><div><p>deep</p></div></div><p>First "), n, F.lit("</p><p> </p><p>Last &amp; done</p></div><p>outside</p>"))
    return p.select("page_id", "url", F.concat(head, F.col("html")).alias("html"))
