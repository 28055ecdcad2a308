"""Text normalisation as Column expressions: keys, values, tokens, pronouns, relative dates, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recallery.schema import ENTITY_PREFIX, ENTITY_TYPES, MEMORY_PREFIX

# Stop words of the plain profile.
STOPWORDS = ("a", "an", "and", "are", "be", "do", "for", "from", "how", "i", "in", "is", "it", "me", "my", "of", "on", "or", "the", "to", "was", "what", "were", "with", "you", "your", "did", "does", "when", "where", "who", "why")

# The usual list of English stop words, in its usual order, for corpora that were indexed with it.
# Forms with an apostrophe are left out, as no token has one.
ENGLISH_STOPWORDS = tuple(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves
    what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for
    with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how
    all any both each few more most other some such no nor not only own same so than too very s t can will just don should now d ll m o re ve y ain aren couldn didn doesn hadn
    hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn""".split()
)

# The phrases that stand for a day, and how far each lies from the day of the dialog.
DAY_SHIFTS = {"yesterday": -1, "today": 0, "this morning": 0, "this afternoon": 0, "this evening": 0, "tomorrow": 1, "last week": -7, "last weekend": -7, "last month": -30}
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
TIME_PHRASES = (*DAY_SHIFTS, "next month", "a year ago", "one year ago", *(f"last {d}" for d in WEEKDAYS))
MONTHS = ("jan(?:uary)?", "feb(?:ruary)?", "mar(?:ch)?", "apr(?:il)?", "may", "june?", "july?", "aug(?:ust)?", "sep(?:t(?:ember)?)?", "oct(?:ober)?", "nov(?:ember)?", "dec(?:ember)?")

# Prompts.
SHORT_ANSWER = "\nBased on the above context, write an answer in the form of a short phrase for the following question. Answer with exact words from the context whenever possible.\n\nQuestion: {} Short answer:\n"
REFUSABLE = "\nBased on the above context, answer the following question. If the answer is not mentioned in the conversation, reply exactly: Not mentioned in the conversation.\n\nQuestion: {} Short answer:\n"
DATE_HINT = " Use DATE of CONVERSATION to answer with an approximate date."
NO_CONTEXT = "(no retrieved dialogs)"
#: Our own instruction for extraction models; {text} is the slot.
EXTRACTION_PROMPT = "List the entities of this dialog turn as a JSON array of objects with the fields value and type. The type is one of Who, What, When, Where, Why, How, How much. Turn: {text}"

SPACES = r"\s+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c) -> Column:
    """Without white space at either end; null for null."""
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


def blank(c) -> Column:
    """True for null and for nothing but white space."""
    return F.coalesce(trimmed(c), F.lit("")) == ""


def entity_key(c) -> Column:
    """The identity of an entity: lower case, trimmed, one final 's dropped, and then inner spaces joined."""
    low = trimmed(F.lower(F.coalesce(_col(c), F.lit(""))))
    return F.regexp_replace(F.regexp_replace(low, r"'s$", ""), SPACES, " ")


def entity_value(c) -> Column:
    """The shown form: spaces joined, a final 's dropped, then edge punctuation."""
    joined = F.regexp_replace(trimmed(F.coalesce(_col(c), F.lit(""))), SPACES, " ")
    return F.regexp_replace(F.regexp_replace(joined, r"(?i)'s$", ""), r"""^[ .,;:!?"']+|[ .,;:!?"']+$""", "")


def entity_type(c) -> Column:
    """The type if it is one of the seven, else null."""
    t = trimmed(c)
    return F.when(t.isin(*ENTITY_TYPES), t)


def metric_tokens(c) -> Column:
    """Lower-case runs of ASCII letters and digits, repeats kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def search_tokens(c, stopwords=STOPWORDS) -> Column:
    """Tokens of the plain profile: longer than one character and no stop word; repeats kept, not stemmed."""
    return F.filter(metric_tokens(c), lambda t: (F.length(t) > 1) & ~t.isin(*stopwords))


def entity_document(key, value) -> Column:
    """What an entity is found by: key and value, or one of them where they differ in case only or one is missing."""
    k, v = trimmed(F.coalesce(_col(key), F.lit(""))), trimmed(F.coalesce(_col(value), F.lit("")))
    return F.when((k != "") & (v != "") & (F.lower(k) != F.lower(v)), F.concat(k, F.lit(" "), v)).when(k != "", k).otherwise(v)


def literal(c: Column) -> Column:
    """A replacement that stands for itself in a regular expression."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))


def _swap(text: Column, pattern: str, by: Column) -> Column:
    return F.regexp_replace(text, F.lit(pattern), by)


def _where_found(text: Column, flags: str, words: list[str], swapped: Column) -> Column:
    """The swapped text where any of the words stands, else the text as it is: one search instead of one for each word."""
    return F.when(text.rlike(rf"{flags}\b(?:{'|'.join(words)})\b"), swapped).otherwise(text)


def speak_as(text, speaker, previous) -> Column:
    """First-person words become the speaker, second-person words the previous speaker, whole words in any case."""
    out, words = _col(text), []
    for who, plain, owned, itself in ((speaker, ("I", "me"), ("my", "mine"), "myself"), (previous, ("you",), ("your", "yours"), "yourself")):
        by = literal(trimmed(who))
        # a match that is not to change is put back as it stands
        name = F.when(blank(who), "$0").otherwise(by)
        own = F.when(blank(who), "$0").otherwise(F.concat(by, F.lit("'s")))
        for word, put in [(w, name) for w in plain] + [(w, own) for w in owned] + [(itself, name)]:
            out = _swap(out, rf"(?iU)\b{word}\b", put)
            words.append(word)
    return _where_found(_col(text), "(?iU)", words, out)


def dialog_date(c) -> Column:
    """The first day-month-year of a text as a date; null if there is none or no such day."""
    pattern = r"(?i)\b(\d{1,2})\s+(" + "|".join(MONTHS) + r")\s*,?\s*(\d{4})\b"
    day, month, year = (F.regexp_extract(_col(c), pattern, k) for k in (1, 2, 3))
    short = F.initcap(F.substring(month, 1, 3))
    return F.when(day != "", F.try_to_date(F.concat_ws(" ", day, short, year), "d MMM yyyy"))


def shown_date(d) -> Column:
    return F.date_format(_col(d), "d MMMM y")


def previous_weekday(anchor: Column, day: str) -> Column:
    """That weekday one to seven days before."""
    return F.next_day(F.date_sub(anchor, 8), day[:3])


def _month_start(anchor: Column, months: int) -> Column:
    """The same day some months on, capped at the 28th."""
    moved = F.add_months(F.trunc(anchor, "month"), months)
    return F.date_add(moved, F.least(F.dayofmonth(anchor), F.lit(28)) - 1)


def _phrase_date(phrase: str, anchor: Column) -> Column | None:
    """The date that one phrase names on the day ``anchor``; None for other phrases."""
    if phrase in DAY_SHIFTS:
        return F.date_add(anchor, DAY_SHIFTS[phrase])
    if phrase == "next month":
        return _month_start(anchor, 1)
    if phrase in ("a year ago", "one year ago"):
        return _month_start(anchor, -12)
    return previous_weekday(anchor, phrase[5:]) if phrase[:5] == "last " and phrase[5:] in WEEKDAYS else None


def time_word_date(word, anchor: Column) -> Column:
    """The date that a phrase names on the day ``anchor``; null for other phrases."""
    w = F.regexp_replace(trimmed(F.lower(_col(word))), SPACES, " ")
    out = F.when(F.lit(False), F.lit(None).cast("date"))
    for phrase in TIME_PHRASES:
        out = out.when(w == phrase, _phrase_date(phrase, anchor))
    return out


def date_words(text, anchor: Column, words=TIME_PHRASES, loose: bool = False) -> Column:
    """The text with every phrase, longest first, replaced by the day it names where it names one."""
    out, patterns = _col(text), []
    for phrase in sorted({w.strip() for w in words if w.strip()}, key=lambda p: (-len(p), p)):
        named = _phrase_date(" ".join(phrase.lower().split()), anchor)
        if named is not None:
            pattern = (r"\s+" if loose else " ").join(map(_quoted, phrase.split()))
            out = _swap(out, rf"(?i)\b{pattern}\b", F.coalesce(shown_date(named), F.lit("$0")))
            patterns.append(pattern)
    return _where_found(_col(text), "(?i)", patterns, out) if patterns else out


def time_words(text) -> Column:
    """The known phrases that stand in a text, as written in lower case, in the order of the list."""
    low = F.lower(F.coalesce(_col(text), F.lit("")))
    return F.array_compact(F.array(*(F.when(low.rlike(rf"\b{p}\b"), p) for p in TIME_PHRASES)))


def normalized(text, speaker, previous, date_time, words: list[str] | None = None, anchor: Column | None = None) -> Column:
    """Pronouns first, then dates. ``words`` replaces the known phrases by a list of one's own (inner spaces of the
    text may then be of any length). ``anchor`` is the date of ``date_time`` where it is at hand."""
    day = dialog_date(date_time) if anchor is None else anchor
    spoken = speak_as(F.coalesce(_col(text), F.lit("")), speaker, previous)
    return date_words(spoken, day) if words is None else date_words(spoken, day, words, True)


def _quoted(word: str) -> str:
    return "\\Q" + word.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def extraction_text(norm, query, caption) -> Column:
    """What the extractor reads: the normalised text and the image's query, or else its caption."""
    some = lambda c: F.when(~blank(c), trimmed(c))
    image = F.coalesce(some(query), some(caption))
    return trimmed(F.concat_ws(" ", some(norm), F.when(image.isNotNull(), F.concat(F.lit("[Image: "), image, F.lit("]")))))


def search_text(norm, text, speaker, caption, query) -> Column:
    """What a memory is embedded by; missing parts leave their space."""
    return trimmed(F.concat_ws(" ", *(F.coalesce(_col(c), F.lit("")) for c in (norm, text, speaker, caption, query))))


def dialog_line(speaker, text, caption) -> Column:
    shared = F.when(blank(caption), "").otherwise(F.concat(F.lit(" and shared "), trimmed(caption)))
    return F.concat(F.coalesce(_col(speaker), F.lit("")), F.lit(' said, "'), F.coalesce(_col(text), F.lit("")), F.lit('"'), shared)


def digest(c) -> Column:
    return F.substring(F.sha2(F.encode(_col(c), "UTF-8"), 256), 1, 32)


def memory_id(dia_id) -> Column:
    return F.concat(F.lit(MEMORY_PREFIX), _col(dia_id))


def entity_id(key) -> Column:
    return F.concat(F.lit(ENTITY_PREFIX), _col(key))


def mention_id(entity, memory) -> Column:
    return F.concat(F.lit("edge:"), _col(entity), F.lit("->"), _col(memory))


def sequence_id(kind, src, dst) -> Column:
    return F.concat(F.lit("medge:"), _col(kind), F.lit(":"), _col(src), F.lit("->"), _col(dst))


def memory_order(dia_id, session) -> list[Column]:
    """Order of memories: session and turn as numbers where the id has them, else the session, then the id."""
    pattern, d = r"(?i)^D(\d+):(\d+)$", _col(dia_id)
    first, turn = (F.expr(f"try_cast(nullif(regexp_extract({dia_id}, '{pattern.replace(chr(92), chr(92) * 2)}', {k}), '') as bigint)") for k in (1, 2))
    return [F.coalesce(first, _col(session).cast("long"), F.lit(0)), F.coalesce(turn, F.lit(0)), d]


def answer_prompt(question, category, context) -> Column:
    """The context and the question in the template of its category: a date hint for 2, a way out for 5."""
    q = trimmed(F.coalesce(_col(question), F.lit("")))
    q = F.when(_col(category) == 2, F.concat(q, F.lit(DATE_HINT))).otherwise(q)
    body = F.when(_col(category) == 5, F.replace(F.lit(REFUSABLE), F.lit("{}"), q)).otherwise(F.replace(F.lit(SHORT_ANSWER), F.lit("{}"), q))
    given = F.when(F.coalesce(_col(context), F.lit("")) == "", NO_CONTEXT).otherwise(_col(context))
    return F.concat(given, F.lit("\n\n"), body)


def extraction_prompt(text) -> Column:
    return F.replace(F.lit(EXTRACTION_PROMPT), F.lit("{text}"), _col(text))
