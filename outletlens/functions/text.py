"""Column expressions over text: cleaning, language, tokens, eligibility and claim features.

Everything here is built from SQL functions, so it stays inside code generation
and can be pushed below joins and shuffles.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from outletlens.functions import lexicons as L

CJK = r"[\x{4E00}-\x{9FFF}]"
CJK_WIDE = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}]"
CJK_NARROW = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: All of Unicode's white space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """White space of any kind off both ends; without a pattern, which would be tried at every space inside."""
    return F.btrim(c, F.lit(SPACES))


def finds(c: Column, pattern: str) -> Column:
    """Whether ``pattern`` occurs, without regard to case."""
    return c.rlike(f"(?iuU)(?:{pattern})")


def fits(c: Column, pattern: str) -> Column:
    """Whether ``pattern`` takes the whole of ``c``."""
    return c.rlike(f"(?iuU)^(?:{pattern})$")


def lines(text: Column) -> Column:
    """Stripped lines of a text, at any kind of line break."""
    return F.transform(F.split(text, r"\R|[\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}]"), strip)


def is_noise(line: Column) -> Column:
    """Whether a line is page furniture rather than article text."""
    return reduce(lambda a, b: a | b, [fits(line, p) for p in L.NOISE_LINES])


def clean_lines(text: Column) -> Column:
    """The lines of an article without furniture, trailing credits and times."""
    kept = F.filter(lines(text), lambda s: (s != "") & ~is_noise(s))
    cut = F.transform(kept, lambda s: strip(F.regexp_replace(F.regexp_replace(s, f"(?iuU){L.TRAILING_CREDIT}", ""), f"(?U){L.TRAILING_TIME}", "")))
    return F.filter(cut, lambda s: (s != "") & ~is_noise(s))


def clean_text(text: Column) -> Column:
    """``clean_lines`` joined by line feeds."""
    return F.array_join(clean_lines(text), "\n")


def rejoin_decimals(sentences: Column) -> Column:
    """Sentences that were cut inside a decimal number, joined again without a space."""

    # A piece that joins the one before it starts with a digit, so its own end tells whether the next one joins; nothing grows step by step.

    def rejoined(ss):
        begins = F.filter(F.sequence(F.lit(0), F.size(ss) - 1), lambda i: (i == 0) | ~(F.get(ss, i - 1).rlike(r"\d+\.$") & F.get(ss, i).rlike(r"^\d")))
        whole = let(begins, lambda at: F.transform(at, lambda b, k: F.array_join(F.slice(ss, b + 1, F.coalesce(F.get(at, k + 1), F.size(ss)) - b), "")))
        return F.when(F.size(ss) == 0, ss).otherwise(whole)

    return let(F.filter(sentences, lambda s: s.isNotNull()), rejoined)


def sentences(text: Column) -> Column:
    """Sentences: a break after 。！？!?… and at line ends, and after a full stop before a capital or digit."""
    cut = F.split(text, r"(?<=[。！？!?…])(?![。！？!?…])|\n|(?<=[a-z0-9)\"'”’]\.)\s+(?=[A-Z0-9\"'“‘])", -1)
    return rejoin_decimals(F.filter(F.transform(cut, strip), lambda s: s != ""))


def _language(text: Column, cjk: str) -> Column:
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    share = F.regexp_count(text, F.lit(cjk)) / F.when(letters > 0, letters)
    return F.when(F.coalesce(share, F.lit(1.0)) >= 0.15, "zh").otherwise("en")


def detect_language(text: Column) -> Column:
    """zh if at least 0.15 of the letters are CJK, or if there are none; else en."""
    return _language(F.coalesce(text, F.lit("")), CJK_WIDE)


def detect_language_narrow(text: Column) -> Column:
    """``detect_language`` without the second CJK extension, as grammatical roles use it."""
    return _language(F.coalesce(text, F.lit("")), CJK_NARROW)


def has_cjk(text: Column) -> Column:
    return text.rlike(CJK)


def cross_lingual(a: Column, b: Column) -> Column:
    """Whether exactly one of two texts has CJK characters."""
    return has_cjk(a) != has_cjk(b)


def strip_punctuation(c: Column) -> Column:
    """Punctuation off both ends."""
    return F.regexp_replace(c, r"^[\p{P}]+|[\p{P}]+$", "")


def clean_surface(c: Column) -> Column:
    """An entity's surface without leading prepositions and trailing particles; a doubled character before an organisation's ending becomes one."""
    bare = strip_punctuation(strip(c))
    bare = F.regexp_replace(bare, "^(?:在|於|從|由|對|向|與|和|跟|被|把|將|為|及)+(?=.{2,}$)", "")
    bare = F.regexp_replace(bare, "(?<=.{2})(?:的|了|着|著|表示|指出|說|稱)+$", "")
    return strip_punctuation(F.regexp_replace(bare, r"(\p{IsHan})\1(?=(?:部|局|署|院|府|黨|會)$)", "$1"))


def _cjk_text(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x{4E00}-\x{9FFF}]+", "")


def _ngrams(s: Column, n: int) -> Column:
    """All n-grams of a string's characters, in order."""
    last = lambda cs: F.greatest(F.size(cs) - (n - 1), F.lit(0))

    def joined(cs):
        out = F.slice(cs, 1, last(cs))
        for k in range(2, n + 1):
            out = F.zip_with(out, F.slice(cs, k, last(cs)), lambda a, b: F.concat(a, b))
        return out

    return F.element_at(F.transform(F.array(F.split(s, "")), joined), 1)


def ascii_words(text: Column, least: int = 2) -> Column:
    """Lower-case Latin words of ``least`` letters or more, in order."""
    return F.transform(F.filter(F.regexp_extract_all(text, F.lit("[a-zA-Z]+"), F.lit(0)), lambda w: F.length(w) >= least), F.lower)


def cjk_bigrams(text: Column) -> Column:
    """Two-character pieces of a text's CJK characters, across whatever stands between them."""
    return F.array_distinct(_ngrams(_cjk_text(text), 2))


def content_tokens(text: Column) -> Column:
    """Distinct CJK bigrams and Latin words."""
    return F.array_union(cjk_bigrams(text), ascii_words(text))


def predicate_tokens(text: Column) -> Column:
    """Distinct CJK bigrams and trigrams and Latin words of four letters and more that aren't stop words."""
    cjk = _cjk_text(text)
    words = F.filter(ascii_words(text, 4), lambda w: ~w.isin(L.STOP_PREDICATE))
    return F.array_distinct(F.concat(_ngrams(cjk, 2), _ngrams(cjk, 3), words))


def action_tokens(text: Column) -> Column:
    """What follows the start of a clause: CJK bigrams from the fifth character, or words from the fourth."""
    cjk, words = _cjk_text(text), F.split(strip(text), r"\s+")
    plain = lambda w: F.lower(F.regexp_replace(w, r"^[.,]+|[.,]+$", ""))
    later = F.filter(F.slice(words, 4, F.greatest(F.size(words), F.lit(1))), lambda w: (F.length(w) >= 3) & ~F.regexp_replace(F.lower(w), r"^[.,]+|[.,]+$", "").isin(L.STOP_SHORT))
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.when(F.length(cjk) > 6, _ngrams(F.substring(cjk, 5, 1 << 30), 2)).when(F.size(words) > 3, F.transform(later, plain)).otherwise(empty))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements; two empty sets are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def lemma_en(word: Column) -> Column:
    """A verb's base form by suffix rules."""
    w = F.lower(strip(word))
    n = F.length(w)
    cut = lambda k: F.substring(w, F.lit(1), n - k)
    ing, ed = cut(3), cut(2)
    doubled = lambda s: s.rlike(r"(?s)^.+([^ls])\1$")
    short = lambda s: F.substring(s, F.lit(1), F.length(s) - 1)
    mute = lambda s, ends: s.rlike(f"(?:{'|'.join(ends)})$")
    of_ing = F.when(doubled(ing), short(ing)).when(mute(ing, L.MUTE_E_ING), F.concat(ing, F.lit("e"))).otherwise(ing)
    of_ed = F.when(mute(ed, L.WHOLE_ED), ed).when(mute(ed, L.MUTE_E_ED), F.concat(ed, F.lit("e"))).when(doubled(ed), short(ed)).otherwise(ed)
    return (
        F.when((n > 4) & w.rlike("ie[sd]$"), F.concat(cut(3), F.lit("y")))
        .when(w.endswith("ing"), of_ing)
        .when(w.endswith("ed"), of_ed)
        .when((n > 3) & w.endswith("s") & ~w.endswith("ss"), F.when(w.endswith("es"), cut(2)).otherwise(cut(1)))
        .otherwise(w)
    )


def negated(body: Column) -> Column:
    """Whether a clause is negated, in either language."""
    return (has_cjk(body) & body.rlike(L.NEGATION_ZH)) | F.arrays_overlap(F.concat(ascii_words(body, 1), F.array(F.lit(""))), F.array(*map(F.lit, L.NEGATION_EN)))


def modality(body: Column, raw: Column) -> Column:
    """demand, plan, opinion or statement, the first that shows: Chinese marks in the body, English ones in the whole."""
    may = has_cjk(body) | F.lower(raw).rlike(L.MODAL_STEMS)  # one cheap look spares most texts six dear ones
    return F.when(~may, "statement").when(body.rlike(L.DEMAND_ZH) | finds(raw, L.DEMAND_EN), "demand").when(body.rlike(L.PLAN_ZH) | finds(raw, L.PLAN_EN), "plan").when(body.rlike(L.OPINION_ZH) | finds(raw, L.OPINION_EN), "opinion").otherwise("statement")


def attribution(text: Column) -> Column:
    """struct(speaker, body, kind): who is quoted, what is said, and attributed_demand/plan/opinion/fact or none."""
    zh, en = f"(?U){L.SPEECH_ZH}", f"(?iuU){L.SPEECH_EN}"

    def of(text: Column) -> Column:
        part = lambda p, k: strip(F.regexp_extract(text, p, k))
        split = lambda p, fits: let(F.when(text.rlike(p), F.struct(part(p, 1).alias("speaker"), part(p, 2).alias("body"))), lambda x: F.when(fits(x["speaker"]) & (x["body"] != ""), x))
        by_zh = split(zh, lambda s: F.length(s).between(1, 25))
        by_en = split(en, lambda s: (s != "") & (F.size(F.split(s, r"\s+")) <= 8))
        kind = (
            F.when(text.rlike(L.DEMAND_ZH) | finds(text, L.DEMAND_EN), "attributed_demand")
            .when(text.rlike(L.PLAN_ZH) | finds(text, L.PLAN_EN), "attributed_plan")
            .when(text.rlike(L.OPINION_ZH) | finds(text, L.OPINION_EN), "attributed_opinion")
            .otherwise("attributed_fact")
        )
        said = lambda x: F.struct(x["speaker"].alias("speaker"), F.coalesce(x["body"], text).alias("body"), F.when(x.isNotNull(), kind).otherwise("none").alias("kind"))
        return let(F.coalesce(by_zh, by_en), said)

    return let(text, of)


def speaker_tokens(name: Column) -> Column:
    """Words and CJK bigrams that tell speakers apart; titles don't."""
    clean = speaker_name(name)
    words = F.filter(ascii_words(clean), lambda w: ~w.isin(L.TITLES_EN))
    return F.array_union(words, F.filter(cjk_bigrams(clean), lambda b: ~b.isin(L.TITLES_ZH)))


def speaker_name(name: Column) -> Column:
    """A speaker without what says when or where they spoke."""
    return strip(F.regexp_replace(strip(name), L.SPEAKER_TAIL, ""))


def speakers_diverge(a: Column, b: Column) -> Column:
    """Whether two quoted speakers are different people; false where one is missing."""
    x, y, s, t = speaker_name(a), speaker_name(b), speaker_tokens(a), speaker_tokens(b)
    apart = F.when((x == "") | (y == "") | F.contains(x, y) | F.contains(y, x), False).when((F.size(s) > 0) & (F.size(t) > 0), ~F.arrays_overlap(s, t)).otherwise(x != y)
    return F.coalesce(F.when(a.isNotNull() & b.isNotNull(), apart), F.lit(False))


def phase_conflict(a: Column, b: Column) -> Column:
    """One text says that something is over, the other that it begins."""
    return (finds(a, L.COMPLETED) & finds(b, L.INITIATED)) | (finds(a, L.INITIATED) & finds(b, L.COMPLETED))


def direction_conflict(a: Column, b: Column) -> Column:
    """One text tells of a rise, the other of a fall."""
    return (finds(a, L.INCREASE) & finds(b, L.DECREASE)) | (finds(a, L.DECREASE) & finds(b, L.INCREASE))


def eligibility(text: Column) -> Column:
    """struct(eligible, reason): the first rule that a candidate claim breaks."""
    told = lambda reason: F.struct(reason.isNull().alias("eligible"), F.coalesce(reason, F.lit("eligible")).alias("reason"))
    return let(let(strip(F.coalesce(text, F.lit(""))), lambda raw: let(F.length(_cjk_text(raw)), lambda cjk: _broken_rule(raw, cjk))), told)


def _broken_rule(raw: Column, cjk: Column) -> Column:
    """The first rule that a stripped text of ``cjk`` Chinese characters breaks, null if none."""
    no_words = ~raw.rlike("[a-zA-Z]{2,}")
    rest = strip(F.regexp_replace(raw, f"(?iuU)^{L.BYLINE}", ""))
    count = lambda c, p: F.regexp_count(c, F.lit(p))
    zh, en = f"(?U){L.SPEECH_ZH}", f"(?iuU){L.SPEECH_EN}"
    body = lambda p: strip(F.regexp_extract(raw, p, 2))
    speech_end = L.ATTRIBUTION_ONLY[L.ATTRIBUTION_ONLY.index("(?:") + 3 : L.ATTRIBUTION_ONLY.index(")")]  # the verbs, eight letters at most
    has_zh = cjk > 0
    ended = F.when(F.right(raw, F.lit(1)).rlike(r"(?U)[，,：:\s]"), F.regexp_replace(raw, r"(?U)[，,：:\s]+$", "")).otherwise(raw)
    reason = (
        F.when(raw == "", "empty")
        .when((cjk == 0) & no_words, "no words")
        .when((cjk < 2) & no_words & ~((cjk == 1) & raw.rlike(r"\d")), "single character")
        .when(fits(raw, L.UI_NOISE), "page furniture")
        .when(raw.rlike("^[（(\\[{【〔<「『]") & raw.rlike(f"^{L.CREDIT_BRACKETS}$") & finds(raw, L.CREDIT_WORDS), "credit")
        .when(raw.rlike(f"(?iuU)^{L.BYLINE}") & (F.length(_cjk_text(rest)) < 4) & (count(rest, "[a-zA-Z0-9]+") <= 4), "byline")
        .when(F.right(ended, F.lit(8)).rlike(f"(?iuU)(?:{speech_end})$") & fits(raw, L.ATTRIBUTION_ONLY), "attribution only")
        .when((has_zh & raw.rlike(f"(?U)^{L.DISCOURSE_ZH}$")) | fits(raw, L.DISCOURSE_EN), "discourse particle")
        .when((F.length(raw) <= 12) & raw.rlike(f"(?U)^{L.TEMPORAL_ZH}$"), "time only")
        .when(has_zh & raw.rlike(zh) & (F.length(F.regexp_replace(body(zh), r"[^\p{L}\p{N}]", "")) < 2), "attribution only")
        .when(raw.rlike(en) & (count(body(en), r"\S+") < 2), "attribution only")
    )
    return reason
