"""Text operators as Column builders; all run in the JVM, none needs Python on the executors."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L

_SPACE = r"(?U)[\s\x1c-\x1f]+"


def lit_or_col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``x``, which is evaluated once however often ``body`` names it: Spark shares no expressions between branches,
    nor in lambdas, where each name would be a copy of the whole chain before it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def sub(x: Column, pattern: str, by: str = "", flags: str = "(?iu)(?U)") -> Column:
    return F.regexp_replace(x, F.lit(flags + pattern), F.lit(by))


def has(x: Column, pattern: str, flags: str = "(?iu)(?U)") -> Column:
    return F.coalesce(x, F.lit("")).rlike(flags + pattern)


def has_any(x: Column, fragments: list[str]) -> Column:
    """Whether any fragment occurs, anywhere. Searches of bytes, as a pattern of alternatives tries each at each place; a fragment
    that has another one within adds nothing."""
    least = [f for f in dict.fromkeys(fragments) if not any(g != f and g in f for g in fragments)]
    return let(F.coalesce(x, F.lit("")), lambda v: reduce(lambda a, b: a | b, [v.contains(f) for f in least]))


def normalize_text(x: Column | str) -> Column:
    """Null is empty; runs of Unicode white space become a space; trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(lit_or_col(x), F.lit("")), F.lit(_SPACE), F.lit(" ")))


def _fold_table() -> tuple[str, str]:
    """Letters that decompose to one base letter and marks, and those bases, from the Unicode database."""
    found, bases = [], []
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != c:
            found.append(c)
            bases.append(plain)
    return "".join(found), "".join(bases)


_FOLD_FROM, _FOLD_TO = _fold_table()


def fold_text(x: Column | str) -> Column:
    """Normalised, lower case, Latin letters without marks. ``fold_text_udf`` does all of NFKD."""
    return F.regexp_replace(F.translate(F.lower(normalize_text(x)), _FOLD_FROM, _FOLD_TO), F.lit(r"\p{M}+"), F.lit(""))


def fold_text_udf():
    """Full compatibility folding, vectorised over Arrow batches, for scripts beyond Latin."""
    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        def one(t):
            decomposed = unicodedata.normalize("NFKD", " ".join((t or "").split()).lower())
            return "".join(c for c in decomposed if not unicodedata.combining(c))

        return texts.map(one)

    return fold


def normalize_question(x: Column | str) -> Column:
    """Folded, with all but letters, digits, underscores, spaces and question marks made spaces."""
    return normalize_text(F.regexp_replace(fold_text(x), F.lit(r"(?U)[^\w\s?]"), F.lit(" ")))


def strip_edges(x: Column, chars: str = L.EDGE) -> Column:
    inside = re.escape(chars)
    return F.regexp_replace(x, F.lit(f"^[{inside}]+|[{inside}]+$"), F.lit(""))


def strip_urls(x: Column) -> Column:
    return sub(x, L.URL)


def strip_emojis(x: Column) -> Column:
    return F.regexp_replace(x, F.lit(L.EMOJI), F.lit(""))


def redact_contacts(x: Column) -> Column:
    return sub(sub(x, L.EMAIL, "[correo]"), L.PHONE, "[telefono]")


def normalize_chat_text(x: Column | str, urls: bool = True, emojis: bool = True) -> Column:
    """The shared chat cleaning: links, emojis, contacts, times, dates and courtesy words, in this order."""
    clean = normalize_text(x)
    clean = strip_urls(clean) if urls else clean
    clean = strip_emojis(clean) if emojis else clean
    clean = sub(sub(redact_contacts(clean), L.TIME), L.DATE)
    for words in L.NOISE_GROUPS:
        clean = sub(clean, rf"\b({'|'.join(words)})\b")
    return normalize_text(strip_edges(F.regexp_replace(clean, F.lit(r"(?U)\s+([,.;:])"), F.lit("$1"))))


def word_count(x: Column | str) -> Column:
    return F.regexp_count(normalize_text(x), F.lit(r"(?U)\w+"))


def support_tokens(x: Column | str) -> Column:
    """The distinct folded words of four letters or more that are not stop words, in order of appearance."""
    found = F.array_distinct(F.regexp_extract_all(fold_text(x), F.lit("[a-záéíóúñA-ZÁÉÍÓÚÑ]{4,}"), F.lit(0)))
    return F.array_except(found, F.array(*[F.lit(w) for w in sorted({*L.STOPWORDS_ES, *L.STOPWORDS_EN})]))


def has_emoji(x: Column) -> Column:
    return has(x, L.EMOJI, "")


def is_tool_trace(x: Column, folded: Column | None = None) -> Column:
    """``folded``, here and below: the folded text, where a caller has it."""
    return has_any(fold_text(x) if folded is None else folded, L.TRACE_FRAGMENTS)


def is_chat_style(x: Column, folded: Column | None = None) -> Column:
    return has_emoji(x) | has_any(fold_text(x) if folded is None else folded, L.CHAT_STYLE_FRAGMENTS) | has(normalize_text(x), r"^(hola|buenos dias|buenas tardes|buenas noches|cordial saludo)\b")


def has_time_reference(x: Column, folded: Column | None = None) -> Column:
    return has(x, L.TIME) | has(x, L.DATE) | has_any(fold_text(x) if folded is None else folded, L.TIME_WORDS)


def redact_personal_data(x: Column | str, protected: Column | None = None) -> Column:
    """Contacts and names out; ``protected``, one term of the row, is left as it is."""
    text = normalize_text(x)
    token = "__PROTECTED_0__"
    if protected is not None:
        term = normalize_text(protected)
        quoted = F.concat(F.lit(r"(?iu)\Q"), term, F.lit(r"\E"))
        text = F.when(term != "", F.regexp_replace(text, quoted, F.lit(token))).otherwise(text)
    text = redact_contacts(text)
    names = rf"{L.NAME}(?:\s+{L.NAME}){{0,3}}"
    text = sub(text, rf"\b(hola|buenos dias|buenos días|buenas tardes|buenas noches),?\s+{names}", "$1")
    text = sub(text, rf"\b(gracias por escribir(?:nos)?),?\s+{names}", "$1")
    text = sub(text, rf"\b{L.NAME}(?:\s+{L.NAME})+\b", "[persona]", "(?U)")
    text = F.regexp_replace(text, F.lit(r"(?U)\s+([,.;:])"), F.lit("$1"))
    if protected is not None:
        text = F.replace(text, F.lit(token), normalize_text(protected))
    return normalize_text(text)


def clean_question_evidence(x: Column | str) -> Column:
    clean = sub(normalize_chat_text(redact_personal_data(x)), rf"\b(?:{'|'.join(L.DAY_WORDS)})\b")
    return normalize_text(strip_edges(clean))


def _upper_first(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))


def clean_faq_answer(x: Column | str, company: Column | None = None) -> Column:
    text = redact_personal_data(x, company)
    for at, (pattern, by) in enumerate(L.ANSWER_REWRITES):
        text = sub(text, pattern, by, "(?iu)(?U)(?s)" if at == 0 else "(?iu)(?U)")
    text = normalize_text(strip_edges(sub(text, r"\[persona\],?\s*", "", "(?U)"), " -:;,."))
    ended = lambda t: F.when(t.rlike(r"[.!?]$"), t).otherwise(F.concat(t, F.lit(".")))
    return let(text, lambda t: F.when(t == "", F.lit("")).otherwise(_upper_first(ended(t))))


def clean_answer_evidence(x: Column | str, company: Column | None = None) -> Column:
    clean = normalize_text(sub(normalize_chat_text(clean_faq_answer(x, company)), L.PLACEHOLDER))
    return F.when(is_tool_trace(lit_or_col(x)), F.lit("")).otherwise(clean)


def is_answer_evidence_usable(x: Column) -> Column:
    def usable(clean: Column, folded: Column) -> Column:
        return (F.char_length(clean) >= 20) & ~is_tool_trace(clean, folded) & ~is_chat_style(clean, folded) & ~has(clean, L.PLACEHOLDER)

    return let(normalize_text(x), lambda clean: let(fold_text(clean), lambda folded: usable(clean, folded)))


def compact_answer(x: Column | str, most: int = 55) -> Column:
    """The whole answer if short enough, else its first sentence, else the first two, else its first words."""
    ended = lambda cut: F.when(cut.rlike(r"[.!?]$") | (cut == ""), cut).otherwise(F.concat(cut, F.lit(".")))
    short = lambda t: (t != "") & (word_count(t) <= most)

    def shortened(clean: Column) -> Column:
        sentences = F.filter(F.split(clean, r"(?<=[.!])\s+"), lambda s: F.trim(s) != "")
        first = lambda n: normalize_text(F.array_join(F.slice(sentences, 1, n), " "))
        cut = let(strip_edges(F.array_join(F.slice(F.split(clean, " "), 1, most), " "), " ,;:"), ended)
        return let(first(1), lambda one: F.when(short(one), one).otherwise(let(first(2), lambda two: F.when(short(two), two).otherwise(cut))))

    return let(normalize_text(x), lambda clean: F.when(word_count(clean) <= most, clean).otherwise(shortened(clean)))


def clean_canonical_answer(x: Column | str, company: Column | None = None) -> Column:
    return compact_answer(clean_faq_answer(x, company))


def clean_canonical_question(x: Column | str) -> Column:
    def rewritten(clean: Column, folded: Column) -> Column:
        return reduce(lambda rest, r: F.when(has(folded, r[0]), sub(clean, r[0], r[1])).otherwise(rest), reversed(L.QUESTION_REWRITES), clean)

    def asked(clean: Column) -> Column:
        return let(strip_edges(fold_text(clean), " ?"), lambda folded: normalize_text(strip_edges(rewritten(clean, folded), " -:;,.¿?")))

    # an inverted question mark that a rewrite put in front was stripped with the edges
    ended = lambda body: F.when(body == "", F.lit("")).otherwise(F.concat(F.lit("¿"), _upper_first(body), F.lit("?")))
    return let(let(clean_question_evidence(x), asked), ended)


def strip_thinking(x: Column) -> Column:
    """Text without thinking blocks, closed or only ended."""
    return F.trim(F.regexp_replace(F.regexp_replace(x, F.lit("(?is)<think>.*?</think>"), F.lit("")), F.lit("(?is)^.*?</think>"), F.lit("")))


def json_object_text(x: Column) -> Column:
    """The text if it is a JSON object, else what lies from the first brace to the last."""
    clean = strip_thinking(x)
    inner = F.regexp_extract(clean, r"(?s)\{.*\}", 0)
    whole = F.try_parse_json(clean)
    return F.when(whole.isNotNull() & clean.startswith("{"), clean).when(F.try_parse_json(inner).isNotNull() & (inner != ""), inner)


_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.]\d{1,6})?)?)?(Z|[+-]\d{2}:\d{2})?$"


def parse_datetime(x: Column) -> Column:
    """The local time of an ISO text with separators; its offset is dropped, not applied. Other texts give null."""
    local = F.regexp_replace(x, F.lit(r"(Z|[+-]\d{2}:\d{2})$"), F.lit(""))
    return F.when(F.regexp_like(x, F.lit(_ISO)), local.try_cast("timestamp_ntz"))


def merged_json(a: Column, b: Column) -> Column:
    """The fields of two JSON objects, those of the second where both have one. Values stay whole; null counts as no fields."""
    left, right = (F.coalesce(F.from_json(x, "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>")) for x in (a, b))
    return F.to_json(F.map_concat(F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k)), right))


def company_key(company: Column, workspace: Column) -> Column:
    return normalize_text(F.coalesce(F.nullif(company.cast("string"), F.lit("")), workspace.cast("string"), F.lit("unknown")))


def candidate_reject_reason(clean: Column, raw: Column | None = None) -> Column:
    """Why a message is no candidate question: the first rule that rejects, or null. ``raw`` is the text the rules
    on whole messages see; by default the cleaned text, as in the pipeline."""
    edge = " ¿?¡!.,;:-_"
    folded = lambda t: strip_edges(fold_text(t), edge)
    return let(
        normalize_text(clean if raw is None else raw),
        lambda r: let(normalize_chat_text(r), lambda t: let(folded(r), lambda fr: let(folded(t), lambda ft: _first_reject(r, t, fr, ft)))),
    )


def _first_reject(raw: Column, text: Column, raw_folded: Column, folded: Column) -> Column:
    """The first rule that rejects, from the whole and the cleaned text, both folded, too."""
    one_of = lambda words: "|".join(words)
    opens = rf"^(?:(?:{one_of(L.GREETING_STARTS_ES)}|{one_of(L.GREETING_STARTS_EN)}|{one_of(L.THANKS)})(\s+.*)?|(?:{one_of(L.ACKNOWLEDGEMENTS)})(\s+gracias|\s+thank you|\s+thanks)?)$"
    no_contact = lambda x: sub(sub(x, L.EMAIL), L.PHONE)
    rest = normalize_text(strip_edges(no_contact(raw_folded)))
    contact = has(raw, L.EMAIL) | has(raw, L.PHONE) | has(text, L.EMAIL) | has(text, L.PHONE)
    contact_only = contact & ((rest == "") | has(rest, "|".join(L.CONTACT_INTROS)) | rest.isin(L.CONTACT_ONLY))
    courtesy = rf"^(?:{one_of(L.GREETING_STARTS_ES)}|{one_of(L.GREETING_STARTS_EN)}|{one_of(L.THANKS)})[\s,!.¿?]*$"
    compact = F.regexp_replace(folded, F.lit(r"(?U)\s+"), F.lit(""))
    letters = F.split(compact, "")
    most = F.array_max(F.transform(F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda d: d == c))))
    length, words = F.char_length(text), F.size(F.split(text, " "))
    rules = [
        ("courtesy_opening", has(raw_folded, opens)),
        ("empty", text == ""),
        ("too_short", (length < 6) | (words < 2)),
        ("too_long", (length > 320) | (words > 55)),
        ("tool_trace", is_tool_trace(text)),
        ("emoji_only", F.trim(strip_emojis(text)) == ""),
        ("contact_only", contact_only),
        ("nothing_but_contact", strip_edges(no_contact(text)) == ""),
        ("few_letters", F.regexp_count(text, F.lit("[a-zA-ZáéíóúÁÉÍÓÚñÑ]")) < 5),
        ("trivial", folded.isin(L.TRIVIAL)),
        ("courtesy_only", has(folded, courtesy)),
        ("laughter", folded.rlike("^(j+a+|j+e+|h+a+|x+d+|lol+|lmao+)+$")),
        ("repetition", (F.char_length(compact) >= 8) & (most / F.char_length(compact) > 0.65)),
        ("low_value", has_any(folded, L.LOW_VALUE_FRAGMENTS)),
    ]
    reason = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        reason = F.when(rule, F.lit(name)).otherwise(reason)
    return reason
