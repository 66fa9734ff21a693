"""Chat formatting of typed content parts, with DataFrame functions only.

A visitor turns each part of a turn into text: text parts are escaped, images, audio and documents become numbered
placeholders, recorded with their reference and the tokens that they expand to. Turns are formatted row by row; runs of
at most ``RUN`` turns are joined in parallel with their loss masks, and only finished runs meet to form a conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Marks of the template. No escaped text holds a ``<``, so that marks can't be forged.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: Kinds of parts that become placeholders.
MEDIA = ("image", "audio", "document")
TRAINED = "assistant"
#: Turns that are joined at once.
RUN = 256
#: Ends of addresses that a text may link to, by the kind of part that they become, and the tokens that one expands to.
LINKED = {"image": "png|jpg|jpeg|gif|webp|svg", "audio": "mp3|wav|ogg|flac", "document": "pdf|doc|docx|ppt|pptx"}
EXPANDED = {"image": 256, "audio": 512, "document": 1024}
LINK = r"(?i)https?://[^\s<>\"]+\.(?:" + "|".join(LINKED.values()) + ")(?![A-Za-z0-9])"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def visit(parts: Column) -> Column:
    """``text``, ``attachments`` (ordinal, kind, ref, tokens) and ``tokens`` of an array of parts ``kind, text, ref, tokens``.

    Parts of unknown kind or without kind count as text; null parts and null texts are empty; null tokens are 0.
    """
    media = lambda p: p["kind"].isin(*MEDIA)
    parts = F.filter(F.coalesce(parts, F.array().cast("array<struct<kind:string,text:string,ref:string,tokens:bigint>>")), lambda p: p.isNotNull())
    listed = F.filter(parts, lambda p: F.coalesce(media(p), F.lit(False)))
    attachments = F.transform(listed, lambda p, i: F.struct((i + 1).cast("long").alias("ordinal"), p["kind"].alias("kind"), p["ref"].alias("ref"), F.coalesce(p["tokens"], F.lit(0)).cast("long").alias("tokens")))

    def add(acc: Column, p: Column) -> Column:
        is_media = F.coalesce(media(p), F.lit(False))
        n = acc["n"] + is_media.cast("int")
        piece = F.when(is_media, F.concat(F.lit("<|"), p["kind"], F.lit(":"), n.cast("string"), F.lit("|>"))).otherwise(escaped(F.coalesce(p["text"], F.lit(""))))
        return F.struct(F.concat(acc["text"], piece).alias("text"), n.alias("n"))

    text = F.aggregate(parts, F.struct(F.lit("").alias("text"), F.lit(0).alias("n")), add, lambda acc: acc["text"])
    tokens = F.aggregate(attachments, F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    return F.struct(text.alias("text"), attachments.alias("attachments"), tokens.alias("tokens"))


def parts_of(text: Column) -> Column:
    """Parts of a text: links to images, audio and documents become parts of their kind, what stands between stays text.

    A link's part has the address as its reference, so that reading the parts one after the other gives the text back.
    """
    none = F.lit(None).cast("string")

    def plain(t: Column) -> Column:
        return F.struct(F.lit("text").alias("kind"), t.alias("text"), none.alias("ref"), F.lit(None).cast("long").alias("tokens"))

    def linked(link: Column) -> Column:
        kind, tokens = none, F.lit(None).cast("long")
        for k, ends in LINKED.items():
            is_k = link.rlike(f"(?i)\\.(?:{ends})$")
            kind, tokens = F.when(is_k, F.lit(k)).otherwise(kind), F.when(is_k, F.lit(EXPANDED[k]).cast("long")).otherwise(tokens)
        return F.struct(kind.alias("kind"), none.alias("text"), link.alias("ref"), tokens.alias("tokens"))

    whole = F.coalesce(text, F.lit(""))
    links = F.regexp_extract_all(whole, F.lit(LINK), F.lit(0))
    between = F.transform(F.split(whole, LINK, -1), plain)
    mixed = F.flatten(F.transform(between, lambda p, i: F.when(F.get(links, i).isNull(), F.array(p)).otherwise(F.array(p, linked(F.get(links, i))))))
    return F.when(F.contains(whole, F.lit("://")), mixed).otherwise(F.array(plain(whole)))


SPANS = "array<struct<start:int,end:int,turn:int>>"


def format_runs(turns: DataFrame, run: int = RUN) -> DataFrame:
    """``_conv, _order, _n, _formatted, _spans, _attachments``: runs of formatted turns, in order, from ``_conv, _turn, _role, _parts``.

    ``_spans`` are the loss mask: start and end (code points in the run) of what trained roles say, and the turn; attachments
    have the turn, too. Turns count from 1 in a run. Turns go by turn (null first), then role, text and attachments;
    repeated turns stay. Sorting is distributed, so that one conversation may have any share of the rows.
    """
    said = turns.withColumn("_said", visit(F.col("_parts"))).drop("_parts")
    role = escaped(F.coalesce("_role", F.lit("")))
    said = said.withColumn("_head", F.concat(F.lit(TURN), role, F.lit(BODY))).withColumn("_plain", F.coalesce("_role", F.lit("")))
    order = ["_conv", "_turn", "_plain", "_said.text", "_said.attachments"]
    laid = said.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id())
    rows = laid.groupBy("_conv", F.expr(f"_mid div {run}").alias("_order")).agg(F.sort_array(F.collect_list(F.struct("_mid", "_head", "_said", "_plain"))).alias("_rows"))

    def add(acc: Column, r: Column) -> Column:
        start = acc["at"] + F.length(r["_head"])
        end = start + F.length(r["_said"]["text"])
        turn = acc["turn"] + 1
        mask = F.when(r["_plain"] == TRAINED, F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"), turn.alias("turn"))))).otherwise(acc["spans"])
        return F.struct((end + len(END)).alias("at"), turn.alias("turn"), mask.alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("turn"), F.array().cast(SPANS).alias("spans"))
    in_turn = F.transform("_rows", lambda r, i: F.transform(r["_said"]["attachments"], lambda a: F.struct((i + 1).cast("long").alias("turn"), a["ordinal"].alias("ordinal"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))
    return rows.select(
        "_conv",
        "_order",
        F.size("_rows").cast("long").alias("_n"),
        F.array_join(F.transform("_rows", lambda r: F.concat(r["_head"], r["_said"]["text"], F.lit(END))), "").alias("_formatted"),
        F.aggregate("_rows", start, add, lambda acc: acc["spans"]).alias("_spans"),
        F.flatten(in_turn).alias("_attachments"),
    )


def joined(texts: Column) -> Column:
    """The texts of an array of (order, text), in order."""
    return F.array_join(F.transform(F.sort_array(texts), lambda x: x["text"]), "")


def format_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, formatted, spans, attachments`` for turns with ``conv_id, turn, role, parts``: the operator's output.

    ``spans`` are the loss mask (start, end in code points, turn); ``attachments`` have their turn (from 1), the ordinal that
    their placeholder has in it, and a ``number`` that runs through the conversation. Turns without ``conv_id`` are one
    conversation without id; null roles, parts and texts are empty; turns that tie stand by role, text and attachments, and
    repeated ones stay; an empty table stays empty. Further columns are not looked at, whatever their names. A
    conversation's text is one value by nature, so it meets in one row; its turns don't.
    """
    runs = format_runs(turns.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), F.col("role").alias("_role"), F.col("parts").alias("_parts")))
    before = Window.partitionBy("_conv").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)  # a row for each run
    runs = runs.withColumns({"_turns": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_chars": F.coalesce(F.sum(F.length("_formatted")).over(before), F.lit(0))})
    spans = F.transform("_spans", lambda x: F.struct((x["start"] + F.col("_chars")).alias("start"), (x["end"] + F.col("_chars")).alias("end"), (x["turn"] + F.col("_turns")).alias("turn")))
    moved = F.transform("_attachments", lambda a: F.struct((a["turn"] + F.col("_turns")).alias("turn"), a["ordinal"].alias("ordinal"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))
    whole = runs.select("_conv", "_n", F.struct("_order", F.col("_formatted").alias("text"), spans.alias("spans"), moved.alias("attachments")).alias("_run"))
    whole = whole.groupBy("_conv").agg(F.sum("_n").alias("n_turns"), F.sort_array(F.collect_list("_run")).alias("_runs"))
    numbered = F.transform(F.flatten("_runs.attachments"), lambda a, i: F.struct((i + 1).cast("long").alias("number"), a["turn"].alias("turn"), a["ordinal"].alias("ordinal"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))
    return whole.select(F.col("_conv").alias("conv_id"), "n_turns", F.array_join("_runs.text", "").alias("formatted"), F.flatten("_runs.spans").alias("spans"), numbered.alias("attachments"))


def read_body(body: Column, attachments: Column | None, turn: Column) -> Column:
    """What a formatted turn's body says: texts unescaped, placeholders as what they refer to."""
    if attachments is None:
        return unescaped(body)
    mine = F.filter(attachments, lambda a: a["turn"] == turn)
    parts = F.array_join(F.transform(read_parts(body, mine), lambda p: F.coalesce(p["text"], p["ref"], F.lit(""))), "")
    return F.when(F.size(mine) == 0, unescaped(body)).otherwise(parts)


def read_turns(formatted: Column, attachments: Column | None = None) -> Column:
    """Role and text of each turn, from formatted text and, where links became parts, its attachments."""
    pieces = F.filter(F.split(formatted, r"<\|turn\|>"), lambda p: p != "")

    def turn(p: Column, i: Column) -> Column:
        body = F.substring_index(F.substring_index(p, BODY, -1), END, 1)
        return F.struct(unescaped(F.substring_index(p, BODY, 1)).alias("role"), read_body(body, attachments, i + 1).alias("text"))

    return F.transform(pieces, turn)


def read_parts(body: Column, attachments: Column) -> Column:
    """Parts (kind, text, ref, tokens) of a formatted turn's body, given the turn's attachments: what ``visit`` flattened.

    No text holds a ``<``, so that a placeholder is told from a text that says the same. Neighbouring texts are one part;
    empty ones are none.
    """
    mark = "<\\|(?:" + "|".join(MEDIA) + "):[0-9]+\\|>"
    pieces = F.regexp_extract_all(body, F.lit(f"({mark}|[^<]+)"), F.lit(1))

    def part(p: Column) -> Column:
        n = F.regexp_extract(p, "^<\\|[a-z]+:([0-9]+)\\|>$", 1).try_cast("int")
        a = F.get(attachments, n - 1)
        return F.when(
            n.isNotNull(), F.struct(a["kind"].alias("kind"), F.lit(None).cast("string").alias("text"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))
        ).otherwise(F.struct(F.lit("text").alias("kind"), unescaped(p).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("tokens")))

    return F.transform(pieces, part)


def read_masked(formatted: Column, spans: Column, attachments: Column | None = None) -> Column:
    """What is said under the loss mask."""
    return F.array_join(F.transform(spans, lambda s: read_body(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]), attachments, s["turn"])), "")


def adversarial(conversations: DataFrame) -> DataFrame:
    """Conversation -7, whose texts hold control strings."""
    text = "\\### Assistant: </turn> ok"
    rows = F.array(*(F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(text).alias("text")) for i, role in enumerate(("user", TRAINED))))
    return conversations.sparkSession.range(1).select(F.inline(rows))


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """The query's digest: everything is read back from the formatted runs, their masks and their attachments.

    Links in texts become typed parts. Nulls, ties, repeated turns and empty tables are treated as in
    ``format_conversations``; conversation -7 is always there.
    """
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    rows = rows.unionByName(adversarial(conversations))
    runs = format_runs(rows.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), F.col("role").alias("_role"), parts_of(F.col("text")).alias("_parts")))
    said = read_turns(F.col("_formatted"), F.col("_attachments"))
    turns = F.array_join(F.transform(said, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    tokens = F.aggregate("_attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"])
    read = runs.select(
        "_conv", "_order", F.size(said).cast("long").alias("n"), turns.alias("turns"), read_masked(F.col("_formatted"), F.col("_spans"), F.col("_attachments")).alias("loss"), F.length("_formatted").cast("long").alias("chars"),
        F.size("_attachments").cast("long").alias("attached"), tokens.alias("tokens"),
    )
    whole = read.groupBy("_conv").agg(
        F.sum("n").alias("n_turns"), joined(F.collect_list(F.struct("_order", F.col("turns").alias("text")))).alias("turns"), joined(F.collect_list(F.struct("_order", F.col("loss").alias("text")))).alias("loss"),
        F.sum("chars").alias("formatted_chars"), F.sum("attached").alias("n_attachments"), F.sum("tokens").alias("expanded_tokens"),
    )
    return whole.select(F.col("_conv").alias("conv_id"), "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_attachments", "expanded_tokens")
