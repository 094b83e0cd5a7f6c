"""Sources: raw transcripts, turn tables, recognised speech and saved analyses.

A transcript table has ``transcript_id, text``; a turn table ``transcript_id, turn_index, speaker, text,
span``. Everything is partitioned by ``transcript_id``: one exchange serves all windows of a plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as T

CONTINUOUS_CHARS, CONTINUOUS_LINE, MAX_SENTENCES = 5_000, 2_000, 20
#: A sentence ends before a space and a capital, quote or bracket, but not after a title or an initial.
# Fixed value, with the titles that don't end a sentence.
SENTENCE_END = r"(?<=[.!?])(?<!(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Sen|Rep|Gov|Jr|Sr)\.)(?<!(?<!\p{L})\p{Lu}\.) (?=[A-Z\"\[])"
# What opens a new turn in continuous speech.
STRONG_START = (
    r"(?i)^(?:(?:Thank you|Thanks)(?:\s+(?:very much|so much))?[.,]?\s*"
    r"|(?:Yes|No|Yeah|Nope|Nah|Right|Okay|OK|Correct|Exactly|Absolutely|Sure)[.,]?\s+"
    r"|(?:Well|So|Look|See|Now|Okay|Alright|Actually)[.,]\s+"
    r"|(?:Hold on|Wait|Time out|Timeout|Let me)[.,]?\s+"
    r"|(?:I mean|I think|I believe|I would|I'd|In my)[.,]?\s+)"
)
DIRECT_ADDRESS = r"(?i)^(?:Charlie|Mr\.?\s*Kirk|Kirk)[.,]?\s+"
DEFAULT_SPEAKERS = ("KIRK", "QUESTIONER")


class EmptyTranscript(ValueError):
    """A source holds no transcript text."""


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One transcript per file; blank files raise."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("transcript_id"), F.col("value").alias("text"))
    if raw.filter(F.length(T.strip(F.col("text"))) == 0).limit(1).count() or not raw.limit(1).count():
        raise EmptyTranscript("No transcript text supplied")
    return raw


def with_spans(turns: DataFrame) -> DataFrame:
    """Add ``span``: turns lie two characters apart, in order of ``turn_index``."""
    before = Window.partitionBy("transcript_id").orderBy("turn_index").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0)).cast("int")
    return turns.withColumn("_start", start).select("transcript_id", "turn_index", "speaker", "text", F.struct(F.col("_start").alias("start"), (F.col("_start") + F.length("text")).alias("end")).alias("span"))


def from_conversations(conversations: DataFrame) -> DataFrame:
    """Turns of a ``conv_id, turn, role, text`` table."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    speaker = F.coalesce(T.normalize_speaker(F.col("role")), F.lit(T.UNKNOWN))
    return with_spans(conversations.select(F.col("conv_id").alias("transcript_id"), (F.row_number().over(order) - 1).alias("turn_index"), speaker.alias("speaker"), T.strip(F.coalesce("text", F.lit(""))).alias("text")))


def lines(transcripts: DataFrame) -> DataFrame:
    """(transcript_id, line_number, line): stripped lines, numbered from 1."""
    each = transcripts.select("transcript_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), T.LINE_BREAK)).alias("n", "raw"))
    return each.select("transcript_id", (F.col("n") + 1).alias("line_number"), T.strip(F.col("raw")).alias("line"))


def dialect(transcripts: DataFrame) -> DataFrame:
    """Add ``dialect``: labelled, continuous or paragraphs. Row-wise: no shuffle."""
    all_lines = F.transform(F.split(F.coalesce("text", F.lit("")), T.LINE_BREAK), T.strip)
    full = F.filter(all_lines, lambda x: x != "")
    n = F.size(full)
    length = F.length(F.array_join(full, " "))
    labelled = F.exists(full, lambda x: F.regexp_like(x, F.lit(T.SPEAKER_LINE)))
    continuous = ((n <= 2) & (length > CONTINUOUS_CHARS)) | ((n > 0) & (length / n > CONTINUOUS_LINE))
    return transcripts.withColumn("dialect", F.when(labelled, "labelled").when(continuous, "continuous").otherwise("paragraphs"))


def _folded(rows: DataFrame, key: str) -> DataFrame:
    """Join the lines of each (transcript, key) in order; ``line_number`` is the first line's."""
    ordered = F.sort_array(F.collect_list(F.struct("line_number", "piece")))
    joined = rows.groupBy("transcript_id", key).agg(F.min("line_number").alias("line_number"), F.array_join(F.transform(ordered, lambda x: x["piece"]), " ").alias("text"), F.first("speaker").alias("speaker"))
    return joined.select("transcript_id", "line_number", "speaker", "text")


def labelled_utterances(transcripts: DataFrame) -> DataFrame:
    """``NAME: text`` lines open utterances; other lines go on with the speaker's last one."""
    order = Window.partitionBy("transcript_id").orderBy("line_number")
    clean = lambda c: T.collapse_spaces(T.strip_stage_directions(c))
    rows = lines(transcripts).filter("line <> ''")
    named = F.regexp_like("line", F.lit(T.SPEAKER_LINE))
    rows = rows.withColumn("named", named).withColumn("label", F.when(named, T.normalize_speaker(F.regexp_extract("line", T.SPEAKER_LINE, 1))))
    rows = rows.withColumn("speaker", F.coalesce(F.last("label", True).over(order), F.lit(T.UNKNOWN)))
    rows = rows.withColumn("piece", F.when(F.col("named"), clean(F.regexp_extract("line", T.SPEAKER_LINE, 2))).otherwise(clean(F.col("line")))).filter("piece <> ''")
    opens = F.col("named") | F.lag("speaker").over(order).isNull() | (F.lag("speaker").over(order) != F.col("speaker"))
    return _folded(rows.withColumn("utterance", F.sum(opens.cast("int")).over(order)), "utterance")


def paragraph_utterances(transcripts: DataFrame) -> DataFrame:
    """Paragraphs between blank lines; lines that start with # are left out."""
    order = Window.partitionBy("transcript_id").orderBy("line_number")
    rows = lines(transcripts).withColumn("blank", F.col("line") == "").withColumn("paragraph", F.sum(F.col("blank").cast("int")).over(order))
    first = F.coalesce(F.max(F.when(F.col("blank"), F.col("line_number"))).over(order), F.lit(0)) + 1
    rows = rows.withColumn("line_start", first).filter(~F.col("blank") & ~F.startswith(F.col("line"), F.lit("#")))
    rows = rows.select("transcript_id", "paragraph", "line_start", "line_number", F.col("line").alias("piece"), F.lit(T.UNKNOWN).alias("speaker"))
    ordered = F.sort_array(F.collect_list(F.struct("line_number", "piece")))
    joined = rows.groupBy("transcript_id", "paragraph").agg(F.first("line_start").cast("int").alias("line_number"), F.array_join(F.transform(ordered, lambda x: x["piece"]), " ").alias("text"), F.first("speaker").alias("speaker"))
    clean = T.collapse_spaces(T.strip_stage_directions(T.strip_timestamps(F.col("text"))))
    return joined.withColumn("text", clean).filter("text <> ''").select("transcript_id", "line_number", "speaker", "text")


def sentences(texts: DataFrame) -> DataFrame:
    """(transcript_id, sentence_index, sentence, start, end) over texts with single spaces."""
    one = texts.select("transcript_id", T.strip(F.regexp_replace("text", r"(?U)\s+", " ")).alias("t")).filter("t <> ''")
    each = one.select("transcript_id", F.posexplode(F.split("t", SENTENCE_END)).alias("sentence_index", "sentence"))
    before = Window.partitionBy("transcript_id").orderBy("sentence_index").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("sentence") + 1).over(before), F.lit(0)).cast("int")
    return each.withColumn("start", start).withColumn("end", F.col("start") + F.length("sentence"))


def boundary_confidence(before: Column, sentence: Column) -> Column:
    """How strongly a sentence opens a new turn after another."""
    # What ends a question, what ends a turn.
    question = r"\?\s*$"
    thanks = r"(?i)(?:Thank you|Thanks)(?:\s+(?:very much|so much))?[.!]?\s*$"
    signal = lambda c, w: F.when(c, F.lit(w)).otherwise(0.0)
    stage = F.regexp_like(before, F.lit(r"[\])]\s*$")) & F.regexp_like(F.when(F.length(before) > 50, F.substring(before, -50, 50)).otherwise(before), F.lit(r"\[[^\]]+\]|\([^\)]+\)"))
    total = (
        signal(F.regexp_like(before, F.lit(question)) & ~F.regexp_like(sentence, F.lit(question)), 0.3)
        + signal(F.regexp_like(sentence, F.lit(STRONG_START)), 0.35)
        + signal(F.regexp_like(sentence, F.lit(DIRECT_ADDRESS)), 0.4)
        + signal(stage, 0.5)
        + signal(F.regexp_like(sentence, F.lit(r"(?i)^(?:Thank you|Thanks)")), 0.25)
        + signal(F.regexp_like(before, F.lit(thanks)), 0.25)
    )
    return F.least(F.lit(1.0), F.coalesce(total, F.lit(0.0)))


def detected_turns(texts: DataFrame, speakers: tuple[str, str] = DEFAULT_SPEAKERS, most: int = MAX_SENTENCES) -> DataFrame:
    """Turns of continuous speech: cut at boundary signals and after ``most`` sentences; speakers alternate."""
    order = Window.partitionBy("transcript_id").orderBy("sentence_index")
    rows = sentences(texts).withColumn("confidence", boundary_confidence(F.lag("sentence").over(order), F.col("sentence")))
    cut = (F.col("confidence") >= 0.3 - 1e-9) & (F.col("sentence_index") > 0)
    rows = rows.withColumn("run", F.sum(cut.cast("int")).over(order))
    within = Window.partitionBy("transcript_id", "run").orderBy("sentence_index")
    rows = rows.withColumn("part", F.floor((F.row_number().over(within) - 1) / most))
    ordered = F.sort_array(F.collect_list(F.struct("sentence_index", "sentence", "confidence")))
    turns = rows.groupBy("transcript_id", "run", "part").agg(ordered.alias("s"), F.min("start").alias("start"), F.max("end").alias("end"))
    number = F.row_number().over(Window.partitionBy("transcript_id").orderBy("run", "part")) - 1
    speaker = F.when(F.col("turn_index") % 2 == 0, speakers[0]).otherwise(speakers[1])
    confidence = F.when(F.col("turn_index") == 0, F.lit(0.5)).otherwise(F.col("s")[0]["confidence"])
    turns = turns.withColumn("turn_index", number)
    return turns.select("transcript_id", "turn_index", speaker.alias("speaker"), F.transform("s", lambda x: x["sentence"]).alias("sentences"), "start", "end", confidence.alias("confidence"))


def continuous_utterances(transcripts: DataFrame, speakers: tuple[str, str] = DEFAULT_SPEAKERS) -> DataFrame:
    full = F.array_join(F.filter(F.transform(F.split("text", T.LINE_BREAK), T.strip), lambda x: x != ""), " ")
    texts = transcripts.select("transcript_id", T.collapse_spaces(T.strip_timestamps(full)).alias("text"))
    said = T.collapse_spaces(T.strip_stage_directions(F.array_join("sentences", " ")))
    turns = detected_turns(texts, speakers).select("transcript_id", (F.col("turn_index") + 1).cast("int").alias("line_number"), "speaker", said.alias("text"))
    return turns.filter("text <> ''")


def utterances(transcripts: DataFrame, speakers: tuple[str, str] = DEFAULT_SPEAKERS) -> DataFrame:
    """(transcript_id, utterance_index, line_number, speaker, text), by each transcript's dialect."""
    told = dialect(transcripts)
    part = lambda name: told.filter(F.col("dialect") == name).select("transcript_id", "text")
    rows = labelled_utterances(part("labelled")).unionByName(paragraph_utterances(part("paragraphs"))).unionByName(continuous_utterances(part("continuous"), speakers))
    number = F.row_number().over(Window.partitionBy("transcript_id").orderBy("line_number")) - 1
    return rows.withColumn("utterance_index", number).select("transcript_id", "utterance_index", "line_number", "speaker", "text")


def from_transcripts(transcripts: DataFrame, speakers: tuple[str, str] = DEFAULT_SPEAKERS) -> DataFrame:
    """Turns of raw transcripts; one without utterances becomes a single turn of its stripped text."""
    said = utterances(transcripts, speakers).select("transcript_id", F.col("utterance_index").alias("turn_index"), "speaker", "text", F.lit(True).alias("_said"))
    alone = transcripts.select("transcript_id", F.lit(0).alias("turn_index"), F.lit(T.UNKNOWN).alias("speaker"), T.strip(F.coalesce("text", F.lit(""))).alias("text"), F.lit(False).alias("_said"))
    every = said.unionByName(alone).withColumn("_any", F.max("_said").over(Window.partitionBy("transcript_id")))
    return with_spans(every.filter(F.col("_said") == F.col("_any")))


SPEECH = "struct<text:string,audio_duration:double,language_code:string,utterances:array<struct<speaker:string,text:string,start:bigint,end:bigint,confidence:double>>>"


def speech_utterances(results: DataFrame, json_column: str = "json") -> DataFrame:
    """Turns of recognised speech, given as JSON documents ``transcript_id, json``."""
    rows = results.select("transcript_id", F.from_json(json_column, SPEECH).alias("r")).select("transcript_id", F.posexplode("r.utterances").alias("turn_index", "u"))
    return rows.select("transcript_id", "turn_index", F.concat(F.lit("SPEAKER_"), F.coalesce("u.speaker", F.lit("A"))).alias("speaker"), F.coalesce("u.text", F.lit("")).alias("text"), F.col("u.start").alias("start_ms"), F.col("u.end").alias("end_ms"), F.coalesce("u.confidence", F.lit(1.0)).alias("confidence"))


def speech_summary(results: DataFrame, json_column: str = "json") -> DataFrame:
    r = F.from_json(json_column, SPEECH)
    names = F.array_distinct(F.transform("r.utterances", lambda u: u["speaker"]))
    return results.select("transcript_id", r.alias("r")).select("transcript_id", F.coalesce("r.language_code", F.lit("en")).alias("language"), (F.coalesce("r.audio_duration", F.lit(0.0)) * 1000).cast("long").alias("duration_ms"), F.coalesce(F.size(names), F.lit(0)).alias("speaker_count"), F.coalesce(F.size("r.utterances"), F.lit(0)).alias("utterance_count"))


ANALYSIS = "id string, timestamp string, input_text string, input_length bigint, analysis_result struct<success:boolean,result:string,error:string>"


def read_analyses(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    """Saved analyses, one JSON object a line, or one a file however it is laid out; unreadable ones are left out."""
    rows = spark.read.text(path, wholetext=one_per_file).select(F.from_json("value", ANALYSIS).alias("a"))
    return rows.filter(F.col("a.id").isNotNull()).select("a.*")


def recent_analyses(analyses: DataFrame, n: int = 10) -> DataFrame:
    claims = F.coalesce(F.json_array_length(F.get_json_object("analysis_result.result", "$.claims")), F.lit(0))
    return analyses.select("id", "timestamp", "input_length", claims.alias("claims_count")).orderBy(F.desc("timestamp"), "id").limit(n)


def generated_claims(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """Claims in a model's answer: fences go, then a JSON array, or what lies between the outer brackets.

    Items that aren't objects or have no text go; the first of equal claims stays.
    """
    bare = T.strip(F.regexp_replace(F.regexp_replace(T.strip(F.col(raw)), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", ""))
    parsed = F.coalesce(F.from_json(bare, "array<string>"), F.from_json(F.regexp_extract(bare, r"(?s)\[.*\]", 0), "array<string>"))
    items = answers.select("transcript_id", F.posexplode(parsed).alias("position", "item")).filter(F.startswith("item", F.lit("{")))
    rows = items.withColumn("m", F.from_json("item", "map<string,string>")).filter(F.col("m")["text"].isNotNull())
    fields = ("text", "speaker", "type", "confidence")
    rest = F.map_filter("m", lambda k, v: ~k.isin(*fields))
    claim = {"text": T.strip(F.col("m")["text"]), "speaker": F.col("m")["speaker"], "claim_type": F.col("m")["type"], "confidence": F.coalesce(F.col("m")["confidence"].try_cast("double"), F.lit(0.9)), "metadata": rest}
    rows = rows.select("transcript_id", "position", *(c.alias(n) for n, c in claim.items()))
    nth = F.row_number().over(Window.partitionBy("transcript_id", T.squeezed(F.col("text"))).orderBy("position"))
    return rows.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def needs_turn_detection(text: Column) -> Column:
    """Whether a pasted text is treated as continuous speech: long, of few lines, or with few labels on top."""
    full = F.filter(F.transform(F.split(text, "\n"), T.strip), lambda x: x != "")
    top = F.slice(full, 1, 10)

    def labelled(line: Column) -> Column:
        head = F.substring_index(line, ":", 1)
        shouted = (head == F.upper(head)) & (head != F.lower(head))
        return F.contains(line, F.lit(":")) & (shouted | F.startswith(line, F.lit("[")) | F.startswith(line, F.lit("(")))

    return (F.length(text) > 2_000) | (F.size(full) <= 2) | (F.size(F.filter(top, labelled)) < 0.3 * F.size(top))


def long_enough(text: Column, least: int = 50) -> Column:
    return F.length(T.strip(F.coalesce(text, F.lit("")))) >= least
