"""Chat formatting: typed content parts flattened into one training text per conversation.

A visitor walks the parts of each turn in order. Text is escaped; an image, audio or document part
becomes a numbered placeholder (``<image:0>``), and the attachment list records its type, reference,
turn and the number of tokens it expands to. The template is

    <turn>role NEWLINE body </turn> NEWLINE

Inside texts and roles a backslash becomes ``\\b``, ``<`` becomes ``\\l`` (and in roles a newline
``\\n``), so every ``<`` of the output is a control string and the escape is reversible. The loss mask
covers the text parts of assistant turns: spans in code points from the start of their turn, so that
reading them back stays linear in the length of a conversation.

Only DataFrame functions run. Defined results: a missing role, text or part list is empty; a missing
conversation id is a conversation of its own; turns with one number are ordered by role, then by their
parts; an unknown part type is a placeholder of its own name with no tokens; neighbouring text parts
read back as one.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

PART = "struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
TRAINED = "assistant"


def escaped(text):
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescaped(text):
    plain = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\n"), F.lit("\n"))
    return F.replace(plain, F.lit("\\b"), F.lit("\\"))


def text_parts(text):
    """A plain text as a list of one typed part."""
    empty = [F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *empty))


def _tokens(part, patch, audio_rate, page_tokens):
    patches = F.ceil(part["width"] / patch) * F.ceil(part["height"] / patch)
    return F.coalesce(
        F.when(part["type"] == "image", patches)
        .when(part["type"] == "audio", F.ceil(part["seconds"] * audio_rate))
        .when(part["type"] == "document", part["pages"].cast("long") * page_tokens),
        F.lit(0),
    ).cast("long")


def format_chats(messages, patch=14, audio_rate=25, page_tokens=1024, trained=TRAINED):
    """``messages`` (conv_id, turn, role, parts) to one row per conversation.

    Columns: conv_id, formatted, n_turns, turn_starts (code points), loss_spans (turn, start, end),
    attachments (number, type, ref, turn, tokens), expanded_tokens.
    """
    is_text = lambda p: F.coalesce(p["type"], F.lit("text")) == "text"
    parts = F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "parts")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), parts.cast(f"array<{PART}>").alias("parts"))
    rows = rows.withColumn("n_attached", F.size(F.filter("parts", lambda p: ~is_text(p))))
    rows = rows.select("*", F.row_number().over(order).alias("at"), total("n_attached").alias("first_attached"))
    number = lambda i: F.col("first_attached") + F.size(F.filter(F.slice("parts", 1, i), lambda p: ~is_text(p)))
    flat = F.transform(
        "parts",
        lambda p, i: F.struct(
            is_text(p).alias("is_text"),
            F.when(is_text(p), escaped(F.coalesce(p["text"], F.lit(""))))
            .otherwise(F.concat(F.lit("<"), escaped(p["type"]), F.lit(":"), number(i).cast("string"), F.lit(">"))).alias("body"),
        ),
    )
    rows = rows.withColumn("flat", flat)
    head = F.concat(F.lit("<turn>"), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    rows = rows.withColumn("head", head).withColumn("piece", F.concat("head", F.array_join("flat.body", ""), F.lit("</turn>\n")))
    at = lambda i: F.aggregate(F.slice("flat", 1, i), F.char_length("head").cast("long"), lambda a, x: a + F.char_length(x["body"]))
    spans = F.filter(
        F.transform(
            "flat",
            lambda x, i: F.when(
                x["is_text"] & (F.char_length(x["body"]) > 0),
                F.struct((F.col("at") - 1).alias("turn"), at(i).alias("start"), (at(i) + F.char_length(x["body"])).alias("end")),
            ),
        ),
        lambda s: s.isNotNull(),
    )
    attached = F.filter(
        F.transform(
            "parts",
            lambda p, i: F.when(
                ~is_text(p),
                F.struct(
                    number(i).alias("number"), p["type"].alias("type"), p["ref"].alias("ref"), (F.col("at") - 1).alias("turn"),
                    _tokens(p, patch, audio_rate, page_tokens).alias("tokens"),
                ),
            ),
        ),
        lambda s: s.isNotNull(),
    )
    none = F.array().cast("array<struct<turn: int, start: bigint, end: bigint>>")
    rows = rows.select(
        "conv_id",
        F.struct(
            "at", "piece", total(F.char_length("piece").cast("long")).alias("start"),
            F.when(F.col("role") == trained, spans).otherwise(none).alias("spans"), attached.alias("attached"),
        ).alias("row"),
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    return whole.select(
        "conv_id", F.array_join("rows.piece", "").alias("formatted"), F.size("rows").cast("long").alias("n_turns"),
        F.col("rows.start").alias("turn_starts"), F.flatten("rows.spans").alias("loss_spans"),
        F.flatten("rows.attached").alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def read_turns(formatted):
    """Turns of a formatted text: array of (role, body); the body keeps its escapes and placeholders."""
    pieces = F.split(formatted, "</turn>\n")
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    parsed = F.transform(pieces, lambda p: F.struct(F.instr(p, "\n").alias("cut"), p.alias("piece")))
    return F.transform(
        parsed,
        lambda x: F.struct(
            unescaped(F.substring(x["piece"], F.lit(7), x["cut"] - 7)).alias("role"),
            F.substring(x["piece"], x["cut"] + 1, F.char_length(x["piece"])).alias("body"),
            x["piece"].alias("piece"),
        ),
    )


def read_parts(body):
    """Parts of a body: array of (type, text, number); text is unescaped, number is an attachment's."""
    pieces = F.regexp_extract_all(body, F.lit("<[^<>]*>|[^<]+"), F.lit(0))
    mark = lambda p: F.substring(p, F.lit(2), F.char_length(p) - 2)
    return F.transform(
        pieces,
        lambda p: F.when(
            p.startswith("<"),
            F.struct(
                unescaped(F.regexp_replace(mark(p), ":[0-9]+$", "")).alias("type"), F.lit(None).cast("string").alias("text"),
                F.regexp_extract(p, ":([0-9]+)>$", 1).cast("long").alias("number"),
            ),
        ).otherwise(F.struct(F.lit("text").alias("type"), unescaped(p).alias("text"), F.lit(None).cast("long").alias("number"))),
    )


def masked_text(turns, spans):
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(
        F.transform(spans, lambda s: unescaped(F.substring(F.get(turns, s["turn"])["piece"], (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "",
    )


def op2_chat_format(spark, sf_dir):
    probe = "\\### Assistant: </turn> ok"
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    more = spark.range(2).select(
        F.lit(-7).cast(chats.schema["conv_id"].dataType).alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"),
    )
    out = format_chats(chats.unionByName(more).withColumn("parts", text_parts(F.col("text"))))
    out = out.withColumn("turns", read_turns(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), F.array_join(F.coalesce(read_parts(t["body"])["text"], F.array().cast("array<string>")), ""), F.lit("\n"))), "")
    out = out.withColumn("said", said).withColumn("learned", masked_text(F.col("turns"), F.col("loss_spans")))
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"), F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), "expanded_tokens",
    )

