"""Broken prompt and response pairs (problem 2).

Truncation is found by comparison. The responses are sorted by text and
neighbours' common prefixes are compared, at every sentence start: the sorted
list holds the text from each sentence start to that sentence's end. A shortened
version of a whole response stops inside one of its sentences, so its closing
sentence is the beginning of that sentence, and the two meet in the list
wherever they stand in their responses. Of an answer that ends without a mark:

* a closing that others end with a mark is complete (rule ``ended elsewhere``);
* a closing that is the beginning of its next neighbour is ``shortened`` (all
  texts that begin with it follow it directly in the order);
* a closing without such a neighbour is ``alone``: truncated unless ended
  sentences end in the same two words;
* at a ``length limit`` (a length at which unended answers pile up) even a
  complete sentence was cut.

Equal sentences are merged map-side before the shuffle; the list is partitioned
by ranges of whole sentences, so that a beginning which a third of all responses
share is split like any other, and partitions pass their first entry to the one
before. Rules for one pair alone find empty answers, copies of the question,
refusals, another language, and plain marks of a cut (open code block or bracket,
ellipsis, comma, list mark without item).

Defined results: null questions and questions without a word are no cases; a
null answer is ``empty``; each record has at most one defect (the first in the
order empty, copy, refusal, truncated by plain marks, wrong_language, truncated
by comparison); repeated rows are judged each; texts of any length are read
whole; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.keys import compose, word_code, words
from loomline.llm.lang import language_scores
from loomline.session import durable

#: Placeholders of a missing answer, letters and digits only (fixed values).
PLACEHOLDERS = frozenset("null none nil nan na empty noanswer tbd tba todo answer response missing undefined unknown placeholder blank leer keineantwort antwort vide réponse pasderéponse vacío vacio sinrespuesta respuesta".split())
#: Lead-ins and labels longer than this are content.
LEAD_WORDS = 6
_TAG = re.compile(r"<[^<>]*>")
_MARKS = re.compile(r"[\W_]+")
_REFUSAL = re.compile(
    r"\b(?:can(?:'t|not| not)|(?:not |un)able to|won't(?: be able to)?|not possible for me to|must|have to|(?:don't|do not) feel comfortable|not comfortable)\s+"
    r"(?:to\s+)?(?:\w+\s+){0,2}?(?:help|assist|answer|answering|provide|refuse|decline|giv(?:e|ing)|comply|respond|discuss|share|support)\b"
    r"|\bno answer can be given\b|\boutside (?:of )?what i (?:may|can)\b|\bsomething i (?:have to|must) (?:decline|refuse)\b|\bi (?:refuse|decline) to\b"
    r"|\bje (?:dois|préfère) (?:décliner|refuser)\b|\bje ne (?:peux|puis) pas\b|\bje ne suis pas en mesure\b|\bil (?:ne )?m'est (?:pas possible|impossible)\b"
    r"|\b(?:kann|darf|möchte) ich (?:\w+\s+){0,3}?nicht\b|\bich (?:kann|darf) (?:\w+\s+){0,4}?nicht\b|\bmuss ich (?:\w+\s+){0,3}?ablehnen\b|\bich muss (?:\w+\s+){0,3}?ablehnen\b|\bnicht möglich\b"
    r"|\bno (?:puedo|podré)\b|\bno me es posible\b|\bdebo (?:rechazar|declinar)\b|\bno estoy en condiciones\b"
)
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
_ENDED = re.compile(r"[.!?][\"'’”»)\]*_]*$")
_CUT = re.compile(r"(?:…|\.\.\.|\[…\]|\[\.\.\.\]|\(\.\.\.\))[\"')\]]*$|(?:->|=>|→|[,;:(\[{&+=/\\–—-])$")
_ITEM = re.compile(r"(?:[-*+•]|\d+[.)])(?:\s+(.*))?$")
#: Names of the languages, in each of them (fixed values).
LANGUAGE_NAMES = {
    "en": frozenset("english anglais englisch englischer inglés ingles".split()),
    "fr": frozenset("french français francais französisch franzoesisch francés frances".split()),
    "de": frozenset("german allemand deutsch alemán aleman".split()),
    "es": frozenset("spanish espagnol spanisch español espanol castellano".split()),
}
_NAME_TO_LANGUAGE = {name: lang for lang, names in LANGUAGE_NAMES.items() for name in names}
_FENCE = re.compile(r"^\s*(?:```|~~~)", re.M)


def is_empty(answer: str | None, said: list[str] | None = None) -> bool:
    """Null, blank, only marks or markup, or a placeholder. ``said``: the words of the answer, if known."""
    if answer is None:
        return True
    if said is None or "<" in answer:
        said = words(_TAG.sub("", answer) if "<" in answer else answer)
    text = "".join(said)
    return not text or text in PLACEHOLDERS


def is_copy(question: list[str], answer: list[str]) -> bool:
    """The question's words again, with at most a lead-in or a label around them."""
    asked = set(question)
    if not answer:
        return False
    inside = [w in asked for w in answer]
    extra = inside.count(False)
    if extra > LEAD_WORDS or 2 * extra > len(answer):
        return False
    if extra:
        # nothing foreign between the first and the last word taken from the question, but for a label
        head = next((i for i, x in enumerate(inside) if x), len(inside))
        tail = next((i for i, x in enumerate(reversed(inside)) if x), len(inside))
        if extra - head - tail > 1:
            return False
    shared = len(asked.intersection(answer))
    if 4 * shared >= 3 * len(asked):
        # most of it must be there in the question's order
        return len(answer) >= 0.7 * len(question)
    return False


def is_refusal(answer: str) -> bool:
    """Declines in one of its first two sentences, and what else it says is too short to be an answer."""
    text = compose(answer).lower().replace("’", "'").strip()
    first = [p for p in _SENTENCE_END.split(text, maxsplit=2) if p][:2]
    if not any(_REFUSAL.search(p) for p in first) or "```" in text:
        return False
    parts = [p for p in _SENTENCE_END.split(text) if p]
    declining = [bool(_REFUSAL.search(p)) for p in parts]
    rest = sum(len(words(p)) for p, d in zip(parts, declining) if not d)
    return rest <= 12 and max(len(words(p)) for p, d in zip(parts, declining) if d) <= 24


def cut_mark(answer: str) -> bool | None:
    """True: plainly cut. False: plainly complete. None: it only lacks its full stop."""
    text = answer.rstrip()
    if "```" in text or "~~~" in text:
        if len(_FENCE.findall(text)) % 2:
            return True
        if text.endswith(("```", "~~~")):
            return False
    last = text.rsplit("\n", 1)[-1].strip()
    item = _ITEM.match(last)
    if item and not (item[1] or "").strip():
        return True
    if _CUT.search(text):
        return True
    if _ENDED.search(text):
        return False
    tail = words(last)
    if not tail:
        return None
    if last.count("(") > last.count(")") or last.count("[") > last.count("]"):
        return True
    if item:
        return False
    return None


def other_language(question: list[str], answer: list[str]) -> bool:
    """Clearly in different languages of the four, and the question does not ask for it."""
    if len(answer) < 6:
        return False
    a, q = language_scores(answer), language_scores(question)
    la, lq = max(a, key=a.get), max(q, key=q.get)
    if la == lq or a[la] < 3 or q[lq] < 1:
        return False
    if a[la] < 1.5 * a[lq] + 1 or q[lq] <= q[la]:
        return False
    return all(_NAME_TO_LANGUAGE.get(w) != la for w in question)


# ---- sentences of the responses ----

_BREAK = re.compile(r"(?<=[.!?])[\"'’”»)\]*_]*\s+|\n")
_END_MARKS = " .!?\"'’”»)]*_\t\r"
_ELLIPSIS = re.compile(r"(?:…|\.\.|[\[(]\.+[\])])[\"'’”»)\]*_]*$")
_NUMBER = re.compile(r"\d+")


def sentences(text: str) -> list[tuple[str, bool]]:
    """Sentences and lines of a text: (without end mark, numbers as 0, blanks as one blank; whether it had one)."""
    result = []
    for part in _BREAK.split(text.strip()):
        part = part.strip()
        ended = _ENDED.search(part) is not None and not _ELLIPSIS.search(part)
        if bare := " ".join(_NUMBER.sub("0", part.rstrip(_END_MARKS)).split()):
            result.append((bare, ended))
    return result


def last_two(sentence: str) -> int | None:
    """Code of the last two words of a sentence."""
    last = sentence.lower().rsplit(" ", 2)[-2:]
    return word_code(" ".join(last)) if len(last) == 2 else None


def _digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        defects, rules, closings, ended, lengths = [], [], [], [], []
        for question, answer in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            defect = rule = close = None
            end = True
            asked = words(question)
            if asked:
                said = words(answer)
                if is_empty(answer, said):
                    defect = rule = "empty"
                elif is_copy(asked, said):
                    defect = rule = "copy"
                elif is_refusal(answer):
                    defect = rule = "refusal"
                elif cut := cut_mark(answer):
                    defect, rule, end = "truncated", "plain mark", False
                elif other_language(asked, said):
                    defect = rule = "wrong_language"
                elif cut is None:
                    own = sentences(answer)
                    close, end = _digest(own[-1][0]) if own else None, False
            defects.append(defect)
            rules.append(rule)
            closings.append(close)
            ended.append(end)
            lengths.append(len(answer) if answer is not None else 0)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(defects, pa.string()), pa.array(rules, pa.string()), pa.array(closings, pa.binary()), pa.array(ended, pa.bool_()), pa.array(lengths, pa.int32())],
            names=["record_id", "defect", "rule", "closing", "ended", "length"],
        )


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sentence, ended): the sentences of a batch, equal ones merged."""
    for batch in batches:
        found: dict[str, bool] = {}
        for text in batch.column(0).to_pylist():
            if text is not None:
                for sentence, ended in sentences(text):
                    found[sentence] = ended or found.get(sentence, False)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.bool_())], names=["sentence", "ended"])


_COMPARED = "closing binary, pair bigint, shortened boolean, part int, first string, last string"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted partition, three kinds of rows.

    Every sentence that nobody ends, and whether its next neighbour begins with
    it; one row with the first and the last entry of the partition, of which the
    last is still undecided; and the pairs of words in which ended sentences end
    (without closing).
    """
    first = held = None
    pairs: set[int | None] = set()
    for batch in batches:
        out = []
        for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if held is None:
                first = row[0]
            elif not held[1]:
                out.append((_digest(held[0]), last_two(held[0]), row[0].startswith(held[0]), None, None, None))
            if row[1]:
                pairs.add(last_two(row[0]))
            held = row
        if out:
            yield _compared_batch(out)
    if held is not None:
        yield _compared_batch([(None if held[1] else _digest(held[0]), last_two(held[0]), False, TaskContext.get().partitionId(), first, held[0])])
    pairs.discard(None)
    if pairs:
        yield _compared_batch([(None, pair, False, None, None, None) for pair in pairs])


def _compared_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.binary(), pa.int64(), pa.bool_(), pa.int32(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["closing", "pair", "shortened", "part", "first", "last"])


def compared_closings(answers: DataFrame) -> DataFrame:
    """(closing digest, shortened, alike) of every sentence of ``answers`` (answer) that nobody ends."""
    distinct = answers.mapInArrow(_split, "sentence string, ended boolean").groupBy("sentence").agg(F.max("ended").alias("ended"))
    ranged = distinct.repartitionByRange("sentence").sortWithinPartitions("sentence")
    # digests and codes, and two sentences per partition
    compared = durable(ranged.mapInArrow(_neighbours, _COMPARED))
    # one row per partition: its last entry meets the first entry of the next one
    following = F.lead("first").over(Window.orderBy("part"))
    borders = compared.filter("part is not null").withColumn("shortened", F.coalesce(following.startswith(F.col("last")), F.lit(False)))
    inner = compared.filter("part is null")
    unended = inner.unionByName(borders).filter("closing is not null").select("closing", "pair", "shortened")
    ends = inner.filter("closing is null").select("pair").distinct().withColumn("ends_so", F.lit(True))
    alone = unended.filter("not shortened").join(ends, "pair", "left").select("closing", "shortened", F.coalesce("ends_so", F.lit(False)).alias("alike"))
    return unended.filter("shortened").select("closing", "shortened", F.lit(False).alias("alike")).unionByName(alone)


def length_limits(judged: DataFrame, least: int = 8, times: int = 5) -> DataFrame:
    """Lengths at which unended answers pile up, compared with ten lengths either side."""
    opened = judged.filter("not ended").groupBy("length").agg(F.count("*").alias("n"))
    around = opened.select(F.explode(F.sequence(F.col("length") - 10, F.col("length") + 10)).alias("length"), "n").groupBy("length").agg(F.sum("n").alias("near"))
    mean = (F.col("near") - F.col("n")) / 20
    return opened.join(around, "length").filter((F.col("n") >= least) & (F.col("n") >= times * mean)).select("length")


def broken_pairs(df: DataFrame, id_column: str = "record_id", question_column: str = "question", answer_column: str = "answer") -> DataFrame:
    """(record_id, defect, rule) of every defective pair."""
    pairs = df.select(F.col(id_column).cast("bigint").alias("record_id"), F.col(question_column).cast("string").alias("question"), F.col(answer_column).cast("string").alias("answer"))
    # id, verdict and a digest of the closing sentence: no texts
    judged = durable(pairs.mapInArrow(_judge, "record_id bigint, defect string, rule string, closing binary, ended boolean, length int"))
    plain = judged.filter("defect is not null").select("record_id", "defect", "rule")
    open_ = judged.filter("closing is not null").select("record_id", "closing", "length")
    limits = length_limits(judged).withColumn("limited", F.lit(True))
    rule = F.when(F.col("limited"), "length limit").when(F.col("shortened"), "shortened").when(~F.col("alike"), "alone")
    cut = (
        open_.join(compared_closings(pairs.select("answer")), "closing", "left")
        .join(limits, "length", "left")
        .select("record_id", F.lit("truncated").alias("defect"), rule.alias("rule"))
        .filter("rule is not null")
    )
    return plain.unionByName(cut)


def defect_report(broken: DataFrame, df: DataFrame, id_column: str = "record_id") -> DataFrame:
    """(source, defect, rule, records) of the defective pairs."""
    sources = df.select(F.col(id_column).cast("bigint").alias("record_id"), F.coalesce(F.col("source").cast("string"), F.lit("(none)")).alias("source"))
    return broken.join(sources, "record_id").groupBy("source", "defect", "rule").agg(F.count("*").alias("records"))
