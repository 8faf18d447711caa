"""Features of a body text: keywords, entities, evidence, voice, position, originality, precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Word lists and patterns that decide which results a text gets.
STOP_WORDS = [
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are", "as", "at",
    "be", "because", "been", "before", "being", "below", "between", "both", "but", "by", "can", "did", "do",
    "does", "doing", "down", "during", "each", "few", "for", "from", "further", "had", "has", "have", "having",
    "he", "her", "here", "hers", "herself", "him", "himself", "his", "how", "i", "if", "in", "into", "is", "it",
    "its", "itself", "just", "me", "might", "more", "most", "my", "myself", "no", "nor", "not", "now", "of",
    "off", "on", "once", "only", "or", "other", "our", "ours", "ourselves", "out", "over", "own", "same", "she",
    "should", "so", "some", "such", "than", "that", "the", "their", "theirs", "them", "themselves", "then",
    "there", "these", "they", "this", "those", "through", "to", "too", "under", "until", "up", "very", "was",
    "we", "were", "what", "when", "where", "which", "while", "who", "whom", "why", "will", "with", "would",
    "you", "your", "yours", "yourself", "yourselves",
]
KEYWORD = r"\b[a-zA-Z][a-zA-Z\-']{2,}\b"
QUESTION = r"(?m)(?:^|[.!?]\s+|\n\s*)((?:What|Why|How|When|Where|Who|Which|Is|Are|Do|Does|Can|Should|Will|Could|Would|May|Might)\b[^.!?\n]{3,180}\?)"
CREDENTIALS = r"(MD|Ph\.?D\.?|MBA|MSc|MPH|DDS|DMD|JD|RN|DO|DPM|OD|PharmD|DVM|EdD|PsyD)"
NAME_WITH_CREDENTIAL = r"\b([A-Z][a-zA-Z\-']+(?:\s+[A-Z][a-zA-Z\-']+){1,3})\s*,?\s*" + CREDENTIALS + r"\b"
TITLED_NAME = r"\b(?:Dr\.?|Prof\.?|Professor|Mr|Mrs|Ms|Sir|Dame)\s+([A-Z][a-zA-Z\-']+(?:\s+[A-Z][a-zA-Z\-']+){1,3})"
HONORIFICS = ["Per", "By", "With", "From", "As", "Like", "And", "The", "Dr", "Prof", "Mr", "Mrs", "Ms"]
ORGANIZATION = r"\b([A-Z][A-Za-z0-9&\-]+(?:\s+[A-Z][A-Za-z0-9&\-]+){0,4})\s+(Inc\.?|LLC|Ltd\.?|Limited|Co\.|Corp\.?|Corporation|Foundation|Institute|University|College|Society|Group|Holdings|Hospital|Clinic|Laboratory|Labs|Research)\b"
STATISTIC = r"(?i)\b(\d+(?:,\d{3})*(?:\.\d+)?)\s*(%|percent|x|×|fold|years?|months?|days?|patients?|people|users?|cases?|million|billion)\b"
QUOTE = r"""["“]([^"”]{20,})["”]"""
CLAIM = r"(?i)\b(studies\s+show|research\s+(?:shows?|indicates?|suggests?|finds?)|evidence\s+suggests?|experts\s+agree|data\s+(?:shows?|indicates?)|it\s+is\s+well\s+known|widely\s+accepted)\b"
CITATION = r"(\[\d+\]|\(\d{4}\)|https?://)"
ANSWER_BLOCK = r"(?i)\b(TL;?DR|Key\s+takeaways?|Key\s+points|At\s+a\s+glance|Bottom\s+line|In\s+(?:short|brief)|Quick\s+answer)\b:?"
POSITION_STATISTIC = r"(?i)(\d+(?:,\d{3})*(?:\.\d+)?)\s*(%|percent|years?|months?|patients?|people|users?|cases?)"
POSITION_CREDENTIAL = r"\b(MD|PhD|Ph\.D\.|M\.D\.|MBA|MSc|MPH|DDS|DMD|JD|RN|DO|DPM|OD|PharmD|DVM|EdD|PsyD)\b"
NAMED_CREDENTIAL = r"\b[A-Z][a-zA-Z\-']+(?:\s+[A-Z][a-zA-Z\-']+){0,3}\s*,?\s*" + CREDENTIALS + r"\b"
FAQ = r"(?i)FAQ|Frequently\s+Asked\s+Questions"
AUTHOR = r"(?i)author|by\s+[A-Z]|written\s+by"
ORIGINALITY = {
    "named_quotes": r"""["“][^"”\n]{20,}["”]\s*[—–-]\s*[A-Z][a-z]+(?:\s+[A-Z][a-zA-Z\-']+)+""",
    "sample_sizes": r"(?i)\b(n\s*=\s*\d+|\d+(?:,\d{3})*\s+(patients?|participants?|respondents?|samples?|subjects?|stores?|customers?|transactions?|users?|companies|firms))\b",
    "yoy_deltas": r"(?i)\b(up|down|rose|fell|grew|declined|increased|decreased)\s+(by\s+)?\d+(\.\d+)?\s*(%|percentage\s+points?|pp)\s+(from|since|vs\.?|versus|compared\s+to|year[-\s]over[-\s]year|YoY)\b",
    "first_person_evidence": r"(?i)\b(we\s+(analy[sz]ed|measured|tracked|tested|surveyed|ran|conducted|sampled|interviewed|observed|sequenced|benchmarked|profiled|simulated|modell?ed|replicated|built|build|trained?|train|develop(ed)?|designed|engineered|prototyped|deployed|ship(ped)?|launched|redirect|repair|treat)|our\s+(dataset|study|analysis|sample|cohort|lab|experiment|results|findings|patients|approach|team\s+(found|measured|observed|built|developed)))\b",
    "method_disclosure": r"(?i)\b(methodology|inclusion\s+criteria|exclusion\s+criteria|study\s+design|sample\s+size|control\s+group|double[-\s]blind|randomi[sz]ed|cross[-\s]sectional)\b",
    "numbered_citations": r"\[\d{1,3}\]",
}
SAMPLE_KINDS = {"named_quotes": "named_quote", "sample_sizes": "sample_size", "yoy_deltas": "yoy_delta", "first_person_evidence": "first_person_evidence", "method_disclosure": "method_disclosure"}
PRECISION = {
    "filler_words": r"(?i)\b(very|really|extremely|quite|rather|somewhat|fairly|absolutely|basically|literally|actually|essentially|simply|just|truly|obviously|clearly|definitely|certainly|particularly|specifically)\b",
    "ly_adverbs": r"(?i)\b[a-z]{4,}ly\b",
    "hedged_modals": r"(?i)\b(might|could|may|should|would|perhaps|possibly|potentially|presumably|arguably)\b",
    "empty_emphasis_adjectives": r"(?i)\b(crucial|essential|important|key|vital|critical|significant|substantial|noteworthy|remarkable|notable|paramount|pivotal)\b",
    "throat_clearing_openers": r"(?im)^(?:in order to|it is also the case that|one of the things that|what this means is|the fact is that|it should be (?:noted|said))\b",
    "filler_phrases": r"(?i)\b(at the end of the day|when all is said and done|in many ways|to a large extent|on a personal level|the fact of the matter is|the bottom line is)\b",
    "passive_voice": r"(?i)\b(?:is|was|are|were|been|being)\s+\w+(?:ed|en)\b",
    "proper_nouns": r"\b[A-Z][a-z]{2,}\b",
    "numerics": r"\b\d+(?:[.,]\d+)?(?:%|x|×)?\b",
}
NOT_ADVERBS = ["only", "early", "daily", "weekly", "monthly", "yearly", "family", "really", "fully", "july", "italy"]
#: Penalty by density per 1,000 tokens: (over, points) from the stricter level down.
PENALTIES = {
    "filler_words": [(20.0, 3.0), (10.0, 2.0)],
    "ly_adverbs": [(25.0, 2.0), (15.0, 1.0)],
    "hedged_modals": [(35.0, 2.0), (20.0, 1.0)],
    "empty_emphasis_adjectives": [(15.0, 2.0), (8.0, 1.0)],
    "passive_voice": [(25.0, 2.0), (15.0, 1.0)],
}
DENSITY_NAMES = {"filler_words": "filler_per_1k", "ly_adverbs": "ly_per_1k", "hedged_modals": "hedge_per_1k", "empty_emphasis_adjectives": "empty_emphasis_per_1k", "passive_voice": "passive_per_1k"}
LEAST_TOKENS = 20


def keyword_tokens(text: Column) -> Column:
    """The lower-cased keyword tokens that are no stop words."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(F.transform(T.find_all(text, KEYWORD), F.lower), lambda w: ~F.array_contains(stop, w))


def questions(text: Column) -> Column:
    """The first ten different questions.  In a run of questions every second one is missed, as its start is taken."""
    found = F.transform(T.find_all(text, QUESTION, 1), T.collapse)
    seen = F.aggregate(found, F.array().cast("array<string>"), lambda a, q: F.when(F.exists(a, lambda x: F.lower(x) == F.lower(q)), a).otherwise(F.array_append(a, q)))
    return F.slice(seen, 1, 10)


def top_terms(text: Column) -> Column:
    """struct(primary, density): the five most frequent terms, ties in byte order.  Nothing is shuffled."""

    def of_tokens(words: Column) -> Column:
        # Runs of the sorted tokens: a term's count is the distance to where the next one begins.
        starts = F.filter(F.transform(words, lambda w, i: F.when((i == 0) | (F.get(words, i - 1) != w), i)), lambda i: i.isNotNull())
        counted = T.let(starts, lambda at: F.transform(at, lambda s, k: F.struct((-(F.coalesce(F.get(at, k + 1), F.size(words)) - s)).alias("minus"), F.get(words, s).alias("term"))))
        top = F.slice(F.array_sort(counted), 1, 5)

        def of_top(t: Column) -> Column:
            primary = F.transform(t, lambda x: F.struct(x["term"].alias("term"), (-x["minus"]).alias("count")))
            by_term = F.array_sort(F.transform(t, lambda x: F.struct(x["term"].alias("key"), T.pct(-x["minus"], F.size(words)).alias("value"))))
            return F.struct(primary.alias("primary"), F.map_from_entries(by_term).alias("density"))

        return T.let(top, of_top)

    return T.let(F.array_sort(keyword_tokens(text)), of_tokens)


def keywords(text: Column) -> Column:
    """struct(primary, questions, density)."""
    return T.let(top_terms(text), lambda b: F.struct(b["primary"].alias("primary"), questions(text).alias("questions"), b["density"].alias("density")))


def keyword_counts(docs: DataFrame, text_col: str = "body_text", id_col: str = "doc_id") -> DataFrame:
    """Corpus form: (doc_id, term, count, density, rank) of each document's five most frequent terms."""
    top = T.let(top_terms(F.col(text_col)), lambda k: F.transform(k["primary"], lambda p, i: F.struct(p["term"].alias("term"), p["count"].cast("bigint").alias("count"), k["density"][p["term"]].alias("density"), (i + 1).alias("rank"))))
    return T.rows_of(docs, top, "k", id_col).select(id_col, "k.*")


def strip_honorific(name: Column) -> Column:
    prefix = "|".join(HONORIFICS)
    return F.regexp_replace(T.collapse(name), rf"^(?i:(?:{prefix}) )*(?i:(?:{prefix})$)?", "")


def people(text: Column) -> Column:
    """(name, credentials): names with credentials first, then titled ones; the first of a name counts."""

    def named(pattern: str, credential: Column | None):
        names = T.find_all(text, pattern, 1)
        if credential is None:
            return F.transform(names, lambda n: F.struct(strip_honorific(n).alias("name"), F.lit(None).cast("string").alias("credentials")))
        return F.zip_with(names, credential, lambda n, c: F.struct(strip_honorific(n).alias("name"), F.upper(F.replace(c, F.lit("."), F.lit(""))).alias("credentials")))

    every = F.concat(named(NAME_WITH_CREDENTIAL, T.find_all(text, NAME_WITH_CREDENTIAL, 2)), named(TITLED_NAME, None))
    every = F.filter(every, lambda p: T.n_tokens(p["name"]) >= 2)
    empty = F.array().cast("array<struct<name:string,credentials:string>>")
    return F.aggregate(every, empty, lambda a, p: F.when(F.exists(a, lambda x: x["name"] == p["name"]), a).otherwise(F.array_append(a, p)))


def organizations(text: Column, headings: Column) -> Column:
    """Names with a legal suffix that occur twice or more and are no heading; the first 20 in byte order."""
    titles = F.transform(headings, lambda h: F.lower(T.strip(h)))
    names = F.zip_with(T.find_all(text, ORGANIZATION, 1), T.find_all(text, ORGANIZATION, 2), lambda a, b: F.concat(a, F.lit(" "), b))
    names = T.let(titles, lambda t: F.array_sort(F.filter(names, lambda n: ~F.array_contains(t, F.lower(T.strip(n))))))
    return T.let(names, lambda ns: F.slice(F.array_distinct(F.filter(ns, lambda n, i: F.coalesce(F.get(ns, i + 1) == n, F.lit(False)))), 1, 20))


def organization_counts(docs: DataFrame, headings: DataFrame, text_col: str = "body_text", id_col: str = "doc_id") -> DataFrame:
    """Corpus form of ``organizations``: (doc_id, name, mentions), by anti join and having."""
    text = F.col(text_col)
    names = F.zip_with(T.find_all(text, ORGANIZATION, 1), T.find_all(text, ORGANIZATION, 2), lambda a, b: F.concat(a, F.lit(" "), b))
    rows = T.rows_of(docs, names, "name", id_col).withColumn("title", F.lower(T.strip(F.col("name"))))
    titles = headings.select(id_col, F.lower(T.strip(F.col("heading"))).alias("title"))
    return rows.join(titles, [id_col, "title"], "left_anti").groupBy(id_col, "name").agg(F.count("*").alias("mentions")).where("mentions >= 2")


def entities(text: Column, headings: Column) -> Column:
    return F.struct(people(text).alias("people"), organizations(text, headings).alias("organizations"))


def unsupported_claims(text: Column) -> Column:
    """The first ten claim openers without a citation within 400 characters: (snippet, position_pct)."""
    # Character positions: pieces between claims and the claims themselves, added up.
    pieces, claims = F.split(text, T.unicode(CLAIM)), T.find_all(text, CLAIM)

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["piece"])
        return F.struct((at + F.length(x["claim"])).alias("at"), F.array_append(acc["out"], at).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    places = F.aggregate(F.zip_with(F.slice(pieces, 1, F.size(claims)), claims, lambda p, c: F.struct(p.alias("piece"), c.alias("claim"))), start, step, lambda a: a["out"])
    rows = F.zip_with(places, T.offsets(text, CLAIM), lambda at, n: F.struct(F.substring(text, at + 1, F.lit(400)).alias("window"), n.alias("offset")))
    open_ = F.slice(F.filter(rows, lambda r: ~T.has(r["window"], CITATION)), 1, 10)
    found = T.let(F.greatest(T.n_tokens(text), F.lit(1)), lambda total: F.transform(open_, lambda r: F.struct(T.strip(F.substring(r["window"], 1, 120)).alias("snippet"), T.pct(r["offset"], total).alias("position_pct"))))
    return F.when(T.has(text, CLAIM), found).otherwise(F.array().cast("array<struct<snippet:string,position_pct:double>>"))


def evidence(text: Column) -> Column:
    return F.struct(T.count(text, STATISTIC).alias("stat_count"), T.count(text, QUOTE).alias("quote_count"), unsupported_claims(text).alias("unsupported_claims"))


def _stripped_sentences(text: Column) -> Column:
    return F.filter(F.transform(T.sentences(text), T.strip), lambda s: s != "")


def avg_sentence_words(text: Column) -> Column:
    sizes = F.transform(_stripped_sentences(text), T.n_tokens)
    return T.let(sizes, lambda n: F.when(F.size(n) == 0, 0).otherwise(F.round(F.aggregate(n, F.lit(0), lambda a, x: a + x) / F.size(n)).cast("int")))


def snippet_candidate(text: Column) -> Column:
    """The sentences of the earliest start, and shortest extension, that hold 30 to 50 words; null if none do."""

    def of_sentences(s: Column) -> Column:
        sizes = F.transform(s, T.n_tokens)

        def of_sums(ends: Column) -> Column:
            # ends[i]: words up to and with sentence i.  The first end in reach of a start is at 30 words or more.
            def window(i: Column) -> Column:
                before = F.coalesce(F.get(ends, i - 1), F.lit(0))
                j = F.size(F.filter(ends, lambda e: e < before + 30))
                return F.when(F.coalesce(F.get(ends, j) <= before + 50, F.lit(False)), F.struct(i.alias("i"), j.alias("j")))

            found = F.get(F.filter(F.transform(F.sequence(F.lit(0), F.size(s) - 1), window), lambda w: w.isNotNull()), F.lit(0))
            return F.when(found.isNotNull(), F.array_join(F.slice(s, found["i"] + 1, found["j"] - found["i"] + 1), " "))

        sums = F.aggregate(sizes, F.array().cast("array<int>"), lambda a, n: F.array_append(a, F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + n))
        return F.when(F.size(s) > 0, T.let(sums, of_sums))

    return T.let(_stripped_sentences(text), of_sentences)


def voice(text: Column, schema_types: Column, html_like: Column) -> Column:
    speakable = F.array_contains(schema_types, "SpeakableSpecification") | F.contains(html_like, F.lit('class="speakable"')) | F.contains(html_like, F.lit("class='speakable'"))
    return F.struct(snippet_candidate(text).alias("featured_snippet_candidate"), speakable.alias("speakable_eligible"), avg_sentence_words(text).alias("avg_sentence_words"))


def position_bias(text: Column) -> Column:
    """Where the first answer block, statistic and credential stand, in per cent of the tokens."""
    total = T.n_tokens(text)

    def place(pattern: str) -> Column:
        return F.when(total > 0, T.pct(T.first_offset(text, pattern), total))

    def warn(p: Column) -> Column:
        answer = F.when(p["tldr"] > 10.0, F.concat(F.lit("Answer summary sits at "), number(p["tldr"]), F.lit("% of body. Move into the first 10%.")))
        stat = F.when(p["stat"] > 30.0, F.concat(F.lit("First statistic at "), number(p["stat"]), F.lit("% of body. Front-load citation-worthy numbers.")))
        none = F.when(p["stat"].isNull() & (p["total"] >= 200), F.lit("No statistics detected. Named numerical claims lift AI citation."))
        return F.struct(p["total"].alias("total_words"), p["tldr"].alias("tldr_position_pct"), p["stat"].alias("first_stat_position_pct"), p["cred"].alias("first_credential_position_pct"), F.array_compact(F.array(answer, stat, none)).alias("warnings"))

    places = F.struct(total.alias("total"), place(ANSWER_BLOCK).alias("tldr"), place(POSITION_STATISTIC).alias("stat"), place(POSITION_CREDENTIAL).alias("cred"))
    return T.let(places, warn)


def number(x: Column) -> Column:
    """A double without a fraction of zero."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def _sample(kind: str):
    return lambda m: F.struct(F.lit(kind).alias("kind"), T.snippet(m).alias("snippet"))


def information_gain(text: Column) -> Column:
    """struct(score, counts, samples): six kinds of first-hand signals, the score 10 at most."""
    counts = F.struct(*[T.count(text, p).alias(k) for k, p in ORIGINALITY.items()])

    def of_counts(c: Column) -> Column:
        total = F.least(c["numbered_citations"], F.lit(5))
        for k in SAMPLE_KINDS:
            total = total + c[k]
        samples = [F.transform(F.slice(T.find_all(text, ORIGINALITY[k]), 1, 3), _sample(kind)) for k, kind in SAMPLE_KINDS.items()]
        return F.struct(F.least(total, F.lit(10)).alias("score"), c.alias("counts"), F.flatten(F.array(*samples)).alias("samples"))

    return T.let(counts, of_counts)


def copy_precision(text: Column) -> Column:
    """struct(score, counts, densities, verdict): ten less the penalties for padding."""
    total = T.n_tokens(text)
    counts = {k: T.count(text, p) for k, p in PRECISION.items()}
    counts["ly_adverbs"] = F.size(F.filter(T.find_all(text, PRECISION["ly_adverbs"]), lambda w: ~F.lower(w).isin(NOT_ADVERBS)))
    lengths = F.filter(F.transform(T.sentences(text), T.n_tokens), lambda n: n > 0)
    chars = F.aggregate(F.transform(T.tokens(text), F.length), F.lit(0), lambda a, n: a + n)

    def of_base(b: Column) -> Column:
        n = b["n"].cast("double")
        per_1k = {k: F.round(b[k] * 1000 / n * 10) / 10 for k in PENALTIES}
        mean = F.aggregate(b["lengths"], F.lit(0.0), lambda a, x: a + x) / F.size(b["lengths"])

        def spread(m: Column) -> Column:
            return F.sqrt(F.aggregate(b["lengths"], F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.size(b["lengths"])) / m

        ratio = F.when(F.size(b["lengths"]) >= 4, T.let(mean, spread)).otherwise(0.45)
        word = b["chars"] / n
        concrete = (b["proper_nouns"] + b["numerics"]) * 100 / n
        per = lambda k: _ladder(per_1k[k], PENALTIES[k])
        penalty = per("filler_words") + per("ly_adverbs") + per("hedged_modals") + per("empty_emphasis_adjectives")
        penalty = penalty + F.least(b["throat_clearing_openers"], F.lit(3)) + F.least(b["filler_phrases"], F.lit(3))
        penalty = penalty + F.when((ratio < 0.30) & (F.size(b["lengths"]) >= 6), 2.0).otherwise(0.0) + _ladder(word, [(5.8, 2.0), (5.4, 1.0)])
        penalty = F.when((concrete < 2.0) & (b["n"] >= 200), penalty + 2.0).when(concrete > 5.0, F.greatest(penalty - 0.5, F.lit(0.0))).otherwise(penalty)
        score = 10.0 - F.least(penalty + per("passive_voice"), F.lit(10.0))
        enough = b["n"] >= LEAST_TOKENS
        entries = [(k, b[k]) for k in PRECISION] + [("sentences", F.size(b["lengths"]))]
        full = F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in sorted(entries, key=lambda e: e[0])]))
        densities = {DENSITY_NAMES[k]: v for k, v in per_1k.items()}
        densities |= {"sentence_length_var_ratio": T.half_up(ratio, 3), "avg_word_length_chars": T.half_up(word, 2), "concrete_per_100_words": T.half_up(concrete, 2)}
        dense = F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in sorted(densities.items(), key=lambda e: e[0])]))
        return F.struct(
            F.when(enough, T.half_up(score, 1)).otherwise(0.0).alias("score"),
            F.when(enough, full).otherwise(F.create_map(F.lit("words"), b["n"])).alias("counts"),
            F.when(enough, dense).otherwise(F.create_map().cast("map<string,double>")).alias("densities"),
            F.when(~enough, "insufficient_content").when(score >= 8.0, "tight").when(score >= 5.0, "mid").otherwise("padded").alias("verdict"),
        )

    base = F.struct(total.alias("n"), lengths.alias("lengths"), chars.alias("chars"), *[v.alias(k) for k, v in counts.items()])
    return T.let(base, of_base)


def _ladder(x: Column, levels: list[tuple[float, float]]) -> Column:
    out = F.when(x > levels[0][0], levels[0][1])
    for over, points in levels[1:]:
        out = out.when(x > over, points)
    return out.otherwise(0.0)


def quotable_sentences(text: Column) -> Column:
    """Sentences of 5 to 25 tokens."""
    return F.size(F.filter(T.sentences(text), lambda s: T.n_tokens(s).between(5, 25)))
