"""Personal data by weak supervision, with DataFrame and SQL functions only.

Four base kinds are found by fixed patterns and always stay. Further candidates
(telephone numbers without a plus sign, national ids, IBANs, names, dates of
birth, and secrets: passwords, tokens and keys) come from wider patterns. Every
candidate, base ones too, gets votes of labelers that look at its form, its
check digits, word lists, the words before it and what stands nearby.
Expectation-maximisation over the counts of vote patterns estimates each
labeler's reliability and the probability of each pattern; a naive Bayes span
classifier is then trained on these probabilities with features of the span
itself, and it alone decides on the further candidates.

The text is read once; candidates and votes are written to the shared folder.
There are at most 3 ** len(LABELERS) vote patterns and a few hundred feature
values, whatever the size of the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outletlens.llm import common

#: Base patterns. Possessive repeats and the look-behinds (or the end of the match before) only spare a quadratic search: they match what the plain patterns match.
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")

#: Further candidates; fixed values.
TEL = r"(?<![0-9A-Za-z+])(?:\([0-9]{2,5}\)|0?[0-9]{2,5})[ ./-][0-9]{3,4}[ .-][0-9]{3,5}(?![0-9A-Za-z])"
NATIONAL = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"
BORN = r"(?<![0-9./-])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![0-9./-])"
#: A value given to a word for secrets, or one whose first characters say what it is.
SECRET_WORD = r"(?i:password|passwd|passphrase|pwd|secret|token|bearer|credential|api[_ -]?key|access[_ -]?key|private[_ -]?key|auth[_ -]?key)"
SECRET_MARK = r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[opsur]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,}|sk_(?:live|test)_[0-9A-Za-z]{16,}|eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]+|-----BEGIN [A-Z ]*PRIVATE KEY-----"
SECRET = rf"{SECRET_WORD}[\"']?\s{{0,3}}(?::=|=>|[:=])\s{{0,3}}[\"']?[^\s\"']{{8,}}|(?<![0-9A-Za-z_-])(?:{SECRET_MARK})"
MORE = ("tel", "national", "iban", "name", "born", "secret")

#: Word lists of the gazetteer and context labelers; fixed values.
TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Sr|Sra"
FIRST_NAMES = (
    "James|John|Robert|Michael|William|David|Richard|Joseph|Thomas|Charles|Christopher|Daniel|Matthew|Anthony|Mark|Steven|Andrew|Kevin|Brian|George|Edward|Ronald|Timothy|Jason|Jeffrey|Ryan|Jacob|Gary|Eric|Jonathan"
    "|Mary|Patricia|Jennifer|Linda|Elizabeth|Barbara|Susan|Jessica|Sarah|Karen|Lisa|Nancy|Betty|Margaret|Sandra|Ashley|Emily|Donna|Michelle|Carol|Amanda|Melissa|Deborah|Stephanie|Rebecca|Laura|Sharon|Cynthia|Kathleen|Amy"
    "|Peter|Paul|Hans|Klaus|Wolfgang|Stefan|Andreas|Jürgen|Uwe|Dieter|Ursula|Sabine|Monika|Petra|Renate|Birgit|Heike|Katrin|Anna|Julia"
    "|Pierre|Jean|Michel|Philippe|Alain|Nicolas|Laurent|Olivier|Marie|Claire|Nathalie|Isabelle|Sophie|Camille|Juan|Carlos|José|Antonio|Manuel|Francisco|Javier|Miguel|Carmen|Lucía|Elena|Maria|María|Ana|Pilar|Dolores"
    "|Wei|Mohammed|Muhammad|Ahmed|Ali|Fatima|Aisha|Yusuf|Olga|Ivan|Dmitri|Natalia|Giovanni|Giulia|Marco|Luca"
)
NAME = rf"(?<!\p{{L}})(?=\p{{Lu}})(?:(?:{TITLES})\.? \p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?|(?:{FIRST_NAMES}) \p{{Lu}}\p{{Ll}}+)(?!\p{{L}})"
#: What a text must hold for further candidates to be looked for.
MAY_HOLD = rf"[0-9]|{NAME}|{SECRET_WORD}|PRIVATE KEY"
DOMAINS = "com|org|net|edu|gov|mil|int|io|info|biz|name|app|dev|de|fr|es|uk|eu|us|ca|mx|br|ar|cl|co|pe|ch|at|it|nl|be|lu|dk|se|no|fi|is|ie|pt|pl|cz|sk|hu|ro|bg|gr|tr|ru|ua|il|za|in|cn|jp|kr|tw|sg|au|nz"
FOR = "tel|telephone|phone|fon|telefon|mobile|call|fax|email|mail|contact|kontakt|write to|ssn|social security|passport|iban|account|konto|card|visa|mastercard|born|birth|geboren|name|dear|address|from"
AGAINST = "version|isbn|issn|page|pages|chapter|figure|table|order|item|total|price|release|build|section|no"

LABELERS = ("form", "check", "gazetteer", "context", "nearby", "noise")
FEATURES = ("kind", "length", "before", "after", "digits", "shape", "word")
ROUNDS = 30


def matches(text: Column, pattern: str, kind: str) -> Column:
    """Array of (start, kind, end, found) of the leftmost non-overlapping matches, in code points."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gap"))
    start = F.struct(F.lit(0).alias("at"), _none().alias("spans"))

    def step(acc, x):  # the gap before a match, then the match; the last gap has none
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["found"])
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["found"].alias("found"))
        return F.when(x["found"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans")))

    return F.aggregate(pairs, start, step, lambda acc: acc["spans"])


def _none() -> Column:
    return F.array().cast("array<struct<start:int,kind:string,end:int,found:string>>")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check-digit rule of cards."""
    n = F.length(number)

    def add(acc, i):
        d = F.substring(number, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"


def _holds(kind: str, found: Column) -> Column:
    """The base rule that a match of ``kind`` must keep."""
    n = F.length(_digits(found))
    if kind == "ip":
        return found.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.when(n.between(12, 19), luhn(_digits(found))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _held(found: Column, kind: str) -> Column:
    return F.filter(found, lambda m: _holds(kind, m["found"]))


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start and then kind as listed."""
    rank = F.create_map(*[x for k, name in enumerate(BASE) for x in (F.lit(name), F.lit(k))])
    digit = text.rlike("[0-9]")
    needs = {"email": (EMAIL, F.contains(text, F.lit("@"))), "ip": (IP, digit), "card": (CARD, digit), "phone": (PHONE, F.contains(text, F.lit("+")))}
    kinds = []
    for kind, (pattern, may) in needs.items():
        kinds.append(F.when(may & text.rlike(pattern), _held(matches(text, pattern, kind), kind)).otherwise(_none()))
    ordered = F.transform(F.concat(*kinds), lambda m: F.struct(m["start"].alias("start"), rank[m["kind"]].alias("rank"), m["kind"].alias("kind"), m["end"].alias("end"), m["found"].alias("found")))
    return F.transform(F.array_sort(ordered), lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end"), m["found"].alias("found")))


def _more_spans(text: Column, base: Column) -> Column:
    """Further candidates that touch no base span."""
    digit = text.rlike("[0-9]")
    needs = {"tel": (TEL, digit), "national": (NATIONAL, digit), "iban": (IBAN, digit), "name": (NAME, F.lit(True)), "born": (BORN, digit), "secret": (SECRET, F.lit(True))}
    kinds = [F.when(may & text.rlike(p), matches(text, p, k)).otherwise(_none()) for k, (p, may) in needs.items()]
    free = F.filter(F.concat(*kinds), lambda m: ~F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return F.array_sort(free)


def _votes(text: Column, m: Column) -> Column:
    """A vote of each labeler: 1 personal, -1 not, 0 none."""
    kind, found = m["kind"], m["found"]
    before = F.lower(F.substring(text, F.greatest(F.lit(1), m["start"] - 31), F.least(m["start"], F.lit(32))))
    digits = _digits(found)
    value = F.regexp_replace(found, rf"^{SECRET_WORD}[^0-9A-Za-z]*", "")
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.length(value) >= 12)
    marked = found.rlike(rf"^(?:{SECRET_MARK})")
    form = (
        F.when(kind.isin(*BASE, "national", "iban"), 1).when(kind == "tel", F.when(F.length(digits).between(7, 13), 1).otherwise(-1))
        .when(kind == "secret", F.when(mixed | marked, 1).otherwise(-1)).when(kind == "name", F.when(found.rlike(r" \p{Lu}\p{Ll}+ \p{Lu}"), 1).otherwise(0)).otherwise(0)
    )
    variety = F.size(F.array_distinct(F.split(F.lower(value), "")))
    check = F.when(kind == "card", 1).when(kind == "national", F.when(found.rlike("^(?:000|666|9)|-00-|-0000$"), -1).otherwise(1)).when(kind == "ip", F.when(found.rlike(r"^0*(?:0|127|255)\."), -1).otherwise(1)).when(kind == "born", F.when(digits.rlike("(?:^|[^0-9])(?:3[2-9]|[4-9][0-9])"), -1).otherwise(0)).when(kind == "secret", F.when(variety >= 8, 1).otherwise(-1)).otherwise(0)
    gazetteer = F.when(kind == "email", F.when(F.lower(found).rlike(rf"\.(?:{DOMAINS})$"), 1).otherwise(0)).when(kind == "name", F.when(found.rlike(rf"(?:^|(?:{TITLES})\.? )(?:{FIRST_NAMES})(?!\p{{L}})"), 1).otherwise(0)).when(kind == "secret", F.when(marked | found.rlike(rf"^{SECRET_WORD}"), 1).otherwise(0)).when(kind == "iban", F.when(found.rlike("^(?:DE|FR|ES|IT|GB|NL|BE|AT|CH|PT|PL)"), 1).otherwise(-1)).otherwise(0)
    context = F.when(before.rlike(rf"(?:^|[^\p{{L}}])(?:{FOR})[^\p{{L}}]{{0,4}}(?:\p{{L}}+[^\p{{L}}]{{1,3}})?$"), 1).when(before.rlike(rf"(?:^|[^\p{{L}}])(?:{AGAINST})[^\p{{L}}]{{0,4}}$|[$\x{{20ac}}\x{{a3}}#] ?$"), -1).otherwise(0)
    around = F.concat(F.substring(text, F.greatest(F.lit(1), m["start"] - 63), F.least(m["start"], F.lit(64))), F.lit("|"), F.substring(text, m["end"] + 1, F.lit(64)))
    nearby = F.when(around.rlike("@|[0-9]{5}"), 1).otherwise(0)
    noise = F.when(digits.rlike(r"([0-9])\1{6}|0123456|1234567|7654321"), -1).otherwise(0)
    return F.array(*[v.cast("int") for v in (form, check, gazetteer, context, nearby, noise)])


def _features(text: Column, m: Column) -> Column:
    """A value of each feature: kind, length, what stands on both sides, number of digits, runs of character classes, and what the word before is for."""
    kind_of = lambda c: F.when(c == "", "edge").when(c.rlike(r"\s"), "space").when(c.rlike(r"\p{L}"), "letter").when(c.rlike("[0-9]"), "digit").otherwise("other")
    size = F.least(F.floor((m["end"] - m["start"]) / 4), F.lit(12)).cast("string")
    before = F.when(m["start"] == 0, "").otherwise(F.substring(text, m["start"], F.lit(1)))
    shape = m["found"]
    for pattern, mark in ((r"\p{Lu}+", "A"), (r"\p{Ll}+", "a"), ("[0-9]+", "9"), (r"\s+", " "), (r"[^Aa9 ]+", ".")):
        shape = F.regexp_replace(shape, pattern, mark)
    last = F.lower(F.regexp_extract(F.substring(text, F.greatest(F.lit(1), m["start"] - 31), F.least(m["start"], F.lit(32))), r"(\p{L}+)[^\p{L}]*$", 1))
    word = F.when(last.rlike(rf"^(?:{FOR})$"), "for").when(last.rlike(rf"^(?:{AGAINST})$"), "against").when(last == "", "none").otherwise("other")
    return F.array(m["kind"], size, kind_of(before), kind_of(F.substring(text, m["end"] + 1, F.lit(1))), F.least(F.length(_digits(m["found"])), F.lit(20)).cast("string"), F.substring(shape, 1, 6), word)


def _judged(docs: DataFrame, spans: str) -> DataFrame:
    """``docs`` with all candidates of every text in the column ``spans`` (start, kind, end, base, votes, features)."""
    text = F.coalesce("text", F.lit(""))
    first, more = common.own_names(docs, "base_spans", "more_spans")
    with_base = docs.withColumn(first, F.when(text.rlike("[0-9@+]"), base_spans(text)).otherwise(_none()))
    with_more = with_base.withColumn(more, F.when(text.rlike(MAY_HOLD), _more_spans(text, F.col(first))).otherwise(_none()))
    judged = lambda c, is_base: F.transform(c, lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end"), F.lit(is_base).alias("base"), _votes(text, m).alias("votes"), _features(text, m).alias("features")))
    return with_more.withColumn(spans, F.concat(judged(F.col(first), True), judged(F.col(more), False))).drop(first, more)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and all candidates of every text (``spans``), saved."""
    return common.save(_judged(common.unique_columns(docs, "doc_id", "text"), "spans").select("doc_id", "spans"), "candidates")


#: One round of expectation-maximisation over (votes, n) patterns ``p`` from parameters ``s``: prior, and each labeler's share of 1 among its votes on personal (a) and other (b) spans.
_POSTERIOR = """
1 / (1 + exp(ln(1 - s.prior) - ln(s.prior) + aggregate(sequence(0, size(p.votes) - 1), 0D, (acc, i) -> acc + CASE get(p.votes, i)
  WHEN 1 THEN ln(get(s.b, i)) - ln(get(s.a, i)) WHEN -1 THEN ln(1 - get(s.b, i)) - ln(1 - get(s.a, i)) ELSE 0D END)))
"""
_EM = f"""
aggregate(sequence(1, {ROUNDS}),
  named_struct('prior', 0.5D, 'a', array_repeat(0.8D, {len(LABELERS)}), 'b', array_repeat(0.3D, {len(LABELERS)})),
  (s, r) -> aggregate(array(transform(patterns, p -> named_struct('votes', p.votes, 'w', p.n * ({_POSTERIOR}), 'v', p.n * (1 - ({_POSTERIOR}))))), s, (old, ps) -> named_struct(
    'prior', least(0.98D, greatest(0.02D, aggregate(ps, 0D, (x, p) -> x + p.w) / aggregate(ps, 0D, (x, p) -> x + p.w + p.v))),
    'a', transform(sequence(0, {len(LABELERS) - 1}), i -> (4D + aggregate(ps, 0D, (x, p) -> x + IF(get(p.votes, i) = 1, p.w, 0D))) / (5D + aggregate(ps, 0D, (x, p) -> x + IF(get(p.votes, i) <> 0, p.w, 0D)))),
    'b', transform(sequence(0, {len(LABELERS) - 1}), i -> (1D + aggregate(ps, 0D, (x, p) -> x + IF(get(p.votes, i) = 1, p.v, 0D))) / (5D + aggregate(ps, 0D, (x, p) -> x + IF(get(p.votes, i) <> 0, p.v, 0D)))))))
"""


def reliabilities(found: DataFrame) -> DataFrame:
    """votes, n, posterior of every vote pattern, and the labelers' estimated parameters."""
    patterns = found.select(F.explode("spans").alias("m")).groupBy(F.col("m.votes").alias("votes")).agg(F.count(F.lit(1)).alias("n"))
    one = patterns.agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("patterns"))  # at most 3 ** len(LABELERS) rows
    fitted = one.where("size(patterns) > 0").withColumn("s", F.expr(_EM))
    return fitted.select(F.explode("patterns").alias("p"), "s").select("p.votes", "p.n", F.expr(_POSTERIOR).alias("posterior"), "s.prior", "s.a", "s.b")


def classifier(found: DataFrame, patterns: DataFrame) -> dict[tuple[int, str], float]:
    """Log odds of every (feature, value), and under (-1, "") the prior's; trained on pattern probabilities."""
    spans = found.select(F.explode("spans").alias("m")).groupBy(F.col("m.votes").alias("votes"), F.col("m.features").alias("features")).agg(F.count(F.lit(1)).alias("k"))
    known = spans.join(patterns.select("votes", "posterior"), "votes")
    yes, no = F.sum(F.col("k") * F.col("posterior")), F.sum(F.col("k") * (1 - F.col("posterior")))
    total = known.agg(yes.alias("yes"), no.alias("no")).select(F.lit(-1).alias("f"), F.lit("").alias("v"), "yes", "no")
    each = known.select(F.posexplode("features").alias("f", "v"), "k", "posterior").groupBy("f", "v").agg(yes.alias("yes"), no.alias("no"))
    rows = {(r["f"], r["v"]): (r["yes"] or 0.0, r["no"] or 0.0) for r in total.unionByName(each).collect()}  # one for each feature value
    all_yes, all_no = rows.get((-1, ""), (0.0, 0.0))
    out = {(-1, ""): log((all_yes + 1) / (all_no + 1))}
    for key, (a, b) in rows.items():
        if key[0] >= 0:
            out[key] = log((a + 1) / (all_yes + 20)) - log((b + 1) / (all_no + 20))
    return out


@dataclass
class Model:
    """The classifier: log odds of the prior and of every feature value."""

    prior: float
    odds: dict[tuple[int, str], float]

    def keep(self, spans: Column, threshold: float) -> Column:
        """Base spans and those candidates whose probability by the classifier reaches ``threshold``, each with it."""
        table = F.create_map(*[F.lit(x) for (f, v), w in sorted(self.odds.items()) for x in (f"{f}:{v}", w)]) if self.odds else F.create_map(F.lit(""), F.lit(0.0))

        def score(m):
            odds = F.aggregate(F.sequence(F.lit(0), F.lit(len(FEATURES) - 1)), F.lit(self.prior), lambda acc, i: acc + F.coalesce(table[F.concat_ws(":", i.cast("string"), F.get(m["features"], i))], F.lit(0.0)))
            return 1 / (1 + F.exp(-odds))

        scored = F.transform(spans, lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end"), m["base"].alias("base"), score(m).alias("score")))
        return F.filter(scored, lambda m: m["base"] | (m["score"] >= threshold))


def fit(found: DataFrame) -> Model:
    """Labeler reliabilities and classifier from ``candidates``' spans."""
    patterns = common.save(reliabilities(found), "reliabilities")
    odds = classifier(found, patterns)
    return Model(float(odds.pop((-1, ""))), odds)


def detect(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id and ``spans`` (start, kind, end, base, score) of every text.

    Base spans come first in their order and always stay; a further candidate
    stays if the classifier's probability reaches ``threshold``. Null text counts as empty and has no spans;
    repeated rows give repeated results; an empty table gives no rows.
    """
    found = candidates(docs)
    return found.select("doc_id", fit(found).keep(F.col("spans"), threshold).alias("spans"))


def cleaned(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` with every span of ``detect`` replaced by its kind in brackets; n_chars, where there is one, follows.

    Overlapping spans are replaced together, under the kind that starts first.
    Null text stays null and empty text empty; repeated rows give repeated
    results; an empty table gives no rows. Texts are matched once to train and
    once more to cut them, as no key tells repeated rows apart.
    """
    model, (spans,) = fit(candidates(docs)), common.own_names(docs, "spans")
    marked = _judged(docs, spans).withColumn(spans, F.array_sort(model.keep(F.col(spans), threshold)))
    t = F.col("text")

    def step(acc, m):
        after = F.concat(acc["out"], F.substring(t, acc["at"] + 1, m["start"] - acc["at"]), F.lit("["), F.upper(m["kind"]), F.lit("]"))
        return F.when(m["start"] >= acc["at"], F.struct(m["end"].alias("at"), after.alias("out"))).otherwise(F.struct(F.greatest(acc["at"], m["end"]).alias("at"), acc["out"].alias("out")))

    cut = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t))))
    some = F.size(spans) > 0
    out = marked.withColumn("text", F.when(some, cut).otherwise(t))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(some, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", m["kind"], m["start"], m["end"])), ",")


def digest(detected: DataFrame) -> DataFrame:
    """The counts and joined spans of ``detect``'s result."""
    base = F.filter("spans", lambda m: m["base"])
    count = lambda k: F.size(F.filter("spans", lambda m: m["base"] & (m["kind"] == k))).cast("long").alias(f"n_{k}")
    place = F.create_map(*[x for k, name in enumerate((*BASE, *MORE)) for x in (F.lit(name), F.lit(k))])
    ordered = F.array_sort(F.transform("spans", lambda m: F.struct(m["start"].alias("start"), place[m["kind"]].alias("place"), m["kind"].alias("kind"), m["end"].alias("end"))))
    return detected.select("doc_id", *map(count, BASE), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(ordered).alias("spans"))
