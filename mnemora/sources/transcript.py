"""Chat transcripts as a source, in two grammars: a header line with a name and a time, or labelled fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.functions.text import clip, fingerprint

#: The time formats of transcripts, with and without a year, header lines, field labels, names that are labels.
FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")
YEARLESS = ("MM-dd HH:mm:ss", "MM/dd HH:mm:ss", "MM-dd HH:mm", "M-d HH:mm:ss", "M-d")
COLON = r"^(.+?)[:：]\s*(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}|\d{1,2}-\d{1,2}[ T]\d{2}:\d{2}:\d{2}|\d{4}-\d{2}-\d{2}|\d{1,2}-\d{1,2})$"
HEADER = r"^(.{1,40}?)\s+((?:\d{4}[-/])?\d{1,2}[-/]\d{1,2} \d{1,2}:\d{2}(?::\d{2})?)$"
SWAPPED = r"^((?:\d{4}[-/])?\d{1,2}[-/]\d{1,2} \d{1,2}:\d{2}(?::\d{2})?)\s+(.{1,40})$"
SENDER, TIME, CONTENT = r"^(?:发送者|说话人|昵称)[:：]\s*(.+)$", r"^(?:时间|日期)[:：]\s*(.+)$", r"^(?:内容|消息)[:：]\s*(.*)$"
LABELS = ("时间", "内容", "消息", "消息id", "消息 ID", "msgid")


def parsed_time(text: Column, year: int) -> Column:
    """Seconds since 1970 of a time in one of the formats, 0 for others."""
    t = F.translate(F.trim(text), "T", " ")
    whole = [F.try_to_timestamp(t, F.lit(f)) for f in FORMATS]
    hinted = [F.try_to_timestamp(F.concat(F.lit(f"{year}-"), t), F.lit(f"yyyy-{f}")) for f in YEARLESS]
    return F.coalesce(F.unix_seconds(F.coalesce(*whole, *hinted)), F.lit(0))


def _until_blank(lines: Column) -> Column:
    """Lines from the first that is not blank up to the next that is."""
    from_text = lambda x: F.slice(x, F.greatest(F.array_position(F.transform(x, lambda t: F.trim(t) != ""), True).cast("int"), F.lit(1)), F.size(x))
    start = from_text(lines)
    blank = F.array_position(F.transform(start, lambda t: F.trim(t) == ""), True).cast("int")
    return F.when(F.size(lines) == 0, lines).when(blank > 0, F.slice(start, 1, blank - 1)).otherwise(start)


def messages(lines: DataFrame, year: int, bots: tuple[str, ...] = (), users: tuple[str, ...] = (), file_col: str = "file", line_col: str = "line", text_col: str = "text") -> DataFrame:
    """(file, message, name, speaker_id, ts, role, content, window_tag, fingerprint) from (file, line, text).

    A header, or a line that labels its sender, starts a message. After a header come the lines of its content; after a
    sender come labelled times and contents, and lines that go on with a content. A blank line ends a content; what
    stands before the first start, or after an end, goes, as do messages without content or of a sender who is a label.
    A time that does not parse takes the last one before it in the file, 0 if there is none. Named bots are assistants;
    where only users are named, all others are. Windows by file: a file is one conversation.
    """
    t = F.trim(text_col)
    label = F.trim(F.regexp_extract(t, COLON, 1)).isin(*LABELS)  # a labelled time looks like a header
    fields, colon, first, swapped = t.rlike(SENDER), t.rlike(COLON) & ~label, t.rlike(HEADER), t.rlike(SWAPPED)
    part = lambda pattern, n: F.regexp_extract(t, pattern, n)
    name = F.when(fields, part(SENDER, 1)).when(colon, part(COLON, 1)).when(swapped, part(SWAPPED, 2)).when(first, part(HEADER, 1))
    when = F.when(fields, F.lit(None)).when(colon, part(COLON, 2)).when(swapped, part(SWAPPED, 1)).when(first, part(HEADER, 2))
    by_line = Window.partitionBy(file_col).orderBy(line_col)
    d = lines.select(file_col, line_col, F.col(text_col).alias("_text"), name.alias("name"), when.alias("_when"), fields.alias("_fields"), t.alias("_t"))
    d = d.withColumn("message", F.count("name").over(by_line)).where("message > 0")
    line = F.struct(F.col(line_col).alias("at"), F.col("_text").alias("text"), F.col("_t").alias("t"))
    rest = F.array_sort(F.collect_list(F.when(F.col("name").isNull(), line)))
    g = d.groupBy(file_col, "message").agg(F.max("name").alias("name"), F.max("_when").alias("_when"), F.max("_fields").alias("_fields"), rest.alias("_rest"))
    labelled = F.filter("_rest", lambda x: ~x["t"].rlike(TIME))
    opens = F.array_position(F.transform(labelled, lambda x: x["t"].rlike(CONTENT)), True).cast("int")
    told = F.transform(F.slice(labelled, F.greatest(opens, F.lit(1)), F.size(labelled)), lambda x: F.when(x["t"].rlike(CONTENT), F.regexp_extract(x["t"], CONTENT, 1)).otherwise(x["text"]))
    plain = F.transform("_rest", lambda x: F.when(x["t"].rlike(COLON), "").otherwise(x["text"]))  # a label ends a content
    empty = F.array().cast("array<string>")
    body = F.when(~F.col("_fields"), _until_blank(plain)).when(opens > 0, _until_blank(told)).otherwise(empty)
    times = F.filter(F.transform("_rest", lambda x: F.regexp_extract(x["t"], TIME, 1)), lambda x: x != "")
    stamp = F.when(F.col("_fields"), F.get(times, F.size(times) - 1)).otherwise(F.col("_when"))
    g = g.select(file_col, "message", F.trim("name").alias("name"), F.nullif(parsed_time(stamp, year), F.lit(0)).alias("ts"), clip(F.array_join(body, "\n"), 2000).alias("content"))
    g = g.where(~F.col("name").isin(*LABELS) & (F.col("name") != "") & (F.col("content") != ""))
    g = g.withColumn("ts", F.coalesce(F.last("ts", ignorenulls=True).over(Window.partitionBy(file_col).orderBy("message")), F.lit(0)))
    bot = F.col("name").isin(*bots) if bots else ~F.col("name").isin(*users) if users else F.lit(False)
    g = g.withColumn("role", F.when(bot, "assistant").otherwise("user")).withColumn("speaker_id", F.when(bot, "bot_self").otherwise(F.col("name")))
    return g.select(file_col, "message", "name", "speaker_id", "ts", "role", "content", F.lit("import").alias("window_tag"), fingerprint(F.lit("import"), F.col("speaker_id"), F.col("ts"), F.col("content")).alias("fingerprint"))
