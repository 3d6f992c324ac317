"""Text features: counts, patterns, term weights, personal data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.base import NotFitted, Operator, register, require, run_aggregates, string_columns

# English stop words.
STOP_WORDS = (
    "a about above after again all am an and any are as at be because been before being below between both but by can did do does doing down during each "
    "few for from further had has have having he her here hers him his how i if in into is it its just me more most my no nor not now of off on once only "
    "or other our out over own s same she should so some such t than that the their them then there these they this those through to too under until up "
    "very was we were what when where which while who whom why will with you your"
).split()
# Patterns of personal and web data.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
    "url": r"https?://[^\s]+",
    "phone": r"\+?[0-9]{1,3}[-. ]?\(?[0-9]{3}\)?[-. ]?[0-9]{3}[-. ]?[0-9]{4}",
    "mention": r"@[A-Za-z0-9_]+",
    "hashtag": r"#[A-Za-z0-9_]+",
    "number": r"[0-9]+",
}
PERSONAL = {
    "email": PATTERNS["email"],
    "phone": PATTERNS["phone"],
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "credit_card": r"[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}",
    "ip_address": r"[0-9]{1,3}(\.[0-9]{1,3}){3}",
}
#: Words in a column's name that say what it holds where no pattern can.
KEYWORDS = {
    "name": ["first_name", "last_name", "full_name", "surname", "given_name", "family_name", "user_name", "username"],
    "address": ["address", "street", "city", "zip_code", "zipcode", "postal_code", "state", "country"],
    "date_of_birth": ["dob", "birth_date", "date_of_birth", "birthday"],
    "medical": ["diagnosis", "icd_code", "medical_record", "patient_id", "prescription", "condition", "treatment"],
    "financial": ["account_number", "routing_number", "iban", "swift", "bank_account", "salary", "income"],
}
TOKEN = r"(?U)\b\w+\b"


def tokens(c: Column, lower: bool = True) -> Column:
    return F.regexp_extract_all(F.lower(c) if lower else c, F.lit(TOKEN), F.lit(0))


def words(c: Column) -> Column:
    """Runs of anything but white space."""
    return F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")


class Text(Operator):
    kind = staticmethod(string_columns)


@register("text", "text", "counts of characters, words and sentences")
class TextBasic(Text):
    def __init__(self, columns=None, features=None):
        super().__init__(columns)
        self.features = features

    def expressions(self, df):
        out = {}
        for c in self.columns:
            v = F.coalesce(F.col(c), F.lit(""))
            w = words(v)
            n = F.size(w)
            stop = F.array(*[F.lit(x) for x in STOP_WORDS])
            every = {
                "char_count": F.char_length(v),
                "word_count": n,
                "sentence_count": F.size(F.filter(F.split(v, r"[.!?]+"), lambda s: F.trim(s) != "")),
                "avg_word_length": F.when(n > 0, F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)) / n).otherwise(0.0),
                "digit_count": F.regexp_count(v, F.lit("[0-9]")),
                "upper_count": F.regexp_count(v, F.lit(r"\p{Lu}")),
                "lower_count": F.regexp_count(v, F.lit(r"\p{Ll}")),
                "punct_count": F.regexp_count(v, F.lit(r"(?U)[^\w\s]")),
                "space_count": F.regexp_count(v, F.lit(r"\s")),
                "special_count": F.regexp_count(v, F.lit(r"[^a-zA-Z0-9\s]")),
                "unique_word_count": F.size(F.array_distinct(F.transform(w, F.lower))),
                "unique_word_ratio": F.when(n > 0, F.size(F.array_distinct(F.transform(w, F.lower))) / n).otherwise(0.0),
                "stopword_ratio": F.when(n > 0, F.size(F.filter(F.transform(w, F.lower), lambda x: F.array_contains(stop, x))) / n).otherwise(0.0),
            }
            out |= {f"{c}_{k}": x for k, x in every.items() if self.features is None or k in self.features}
        return out


@register("patterns", "text", "whether and how often patterns occur")
class TextPatterns(Text):
    def __init__(self, columns=None, patterns=None, counts_only=False):
        super().__init__(columns)
        self.patterns, self.counts_only = patterns or PATTERNS, counts_only

    def expressions(self, df):
        out = {}
        for c in self.columns:
            for k, p in self.patterns.items():
                n = F.regexp_count(F.coalesce(F.col(c), F.lit("")), F.lit(f"(?i){p}"))
                if not self.counts_only:
                    out[f"{c}_has_{k}"] = (n > 0).cast("int")
                out[f"{c}_{k}_count"] = n
        return out


def _among(values: list[str]):
    return lambda x: x.isin(values) if values else F.lit(False)


def _same(value):
    return lambda x: x == value


class Vocabulary(Text):
    """Terms by document frequency, ties by term; counted over all texts."""

    def __init__(self, columns=None, most=100, least_df=2, most_df=1.0, ngrams=(1, 1), stop_words=True, lower=True):
        super().__init__(columns)
        self.most, self.least_df, self.most_df, self.ngrams, self.stop_words, self.lower = most, least_df, most_df, ngrams, stop_words, lower

    def terms(self, c: str) -> Column:
        t = tokens(F.coalesce(F.col(c), F.lit("")), self.lower)
        lo, hi = self.ngrams
        parts = [t] if lo == 1 else []
        for n in range(max(2, lo), hi + 1):
            steps = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - (n - 1))).otherwise(F.array().cast("array<int>"))
            parts.append(F.transform(steps, self._joined(t, n)))
        return F.concat(*parts) if len(parts) > 1 else parts[0]

    @staticmethod
    def _joined(t: Column, n: int):
        return lambda i: F.array_join(F.slice(t, i, n), " ")

    def fit(self, df, target=None):
        self.columns, self.state = self.pick(df), {}
        n = df.count()
        for c in self.columns:
            found = df.select(F.explode(F.array_distinct(self.terms(c))).alias("t")).groupBy("t").agg(F.count("*").alias("df"))
            found = found.where((F.col("df") >= self.least_df) & (F.col("df") <= self.most_df * n))
            if self.stop_words:
                found = found.where(~F.col("t").isin(STOP_WORDS))
            self.state[c] = (n, [(r["t"], r["df"]) for r in found.orderBy(F.desc("df"), "t").limit(self.most).collect()])
        return self


@register("counts", "text", "how often frequent terms occur")
class TermCounts(Vocabulary):
    def __init__(self, columns=None, binary=False, **more):
        super().__init__(columns, **({"stop_words": False} | more))
        self.binary = binary

    def expressions(self, df):
        return self.counts({c: self.terms(c) for c in self.columns})

    def counts(self, terms: dict[str, Column]) -> dict[str, Column]:
        out = {}
        for c, t in terms.items():
            for term, _ in self.state[c][1]:
                n = F.size(F.filter(t, _same(term)))
                out[f"{c}_count_{term}"] = (n > 0).cast("int") if self.binary else n
        return out

    def transform(self, df):
        """A text is cut into its terms once, those to be counted are kept."""
        if self.state is None:
            raise NotFitted(type(self).__name__)
        held = {f"_terms_{i}": F.filter(self.terms(c), _among([t for t, _ in self.state[c][1]])) for i, c in enumerate(self.columns)}
        new = self.counts({c: F.col(f"_terms_{i}") for i, c in enumerate(self.columns)})
        self.new_columns = list(new)
        require(df, self.columns)
        return df.withColumns(held).withColumns(new).drop(*held)


@register("tfidf", "text", "weights of frequent terms")
class TfIdf(Vocabulary):
    """Share of a text's terms times ln((N + 1) / (df + 1)) + 1, rows at length 1."""

    def __init__(self, columns=None, **more):
        super().__init__(columns, **({"most_df": 0.95} | more))

    @staticmethod
    def _weight(weights: Column):
        return lambda t: F.size(F.filter("_t", _same(t))) / F.greatest(F.size("_t"), F.lit(1)) * weights[t]

    def transform(self, df):
        out = df
        self.new_columns = []
        for c in self.columns:
            n, vocab = self.state[c]
            weights = F.create_map(*[x for t, d in vocab for x in (F.lit(t), F.ln(F.lit((n + 1) / (d + 1))) + 1)]) if vocab else None
            out = out.withColumn("_t", self.terms(c))
            if not vocab:
                out = out.drop("_t")
                continue
            names = F.array(*[F.lit(t) for t, _ in vocab])
            out = out.withColumn("_w", F.transform(names, self._weight(weights)))
            out = out.withColumn("_l", F.sqrt(F.aggregate("_w", F.lit(0.0), lambda a, x: a + x * x)))
            new = {f"{c}_tfidf_{t}": F.when(F.col("_l") > 0, F.col("_w")[i] / F.col("_l")).otherwise(0.0) for i, (t, _) in enumerate(vocab)}
            out = out.withColumns(new).drop("_t", "_w", "_l")
            self.new_columns += list(new)
        return out


def scan_personal(df: DataFrame, least: float = 0.3, patterns: dict[str, str] | None = None) -> list[dict]:
    """Columns that hold personal data: by name, or by the share of values
    that are one; all columns and patterns in one aggregation. Kinds without a
    pattern (``KEYWORDS``) go by name alone."""
    patterns, cols = patterns or PERSONAL, string_columns(df)
    found = run_aggregates(df, {f"{c}|{k}": F.avg(F.regexp_like(F.col(c), F.lit(f"^(?:{p})$")).cast("double")) for c in cols for k, p in patterns.items()})
    out = []
    for c in df.columns:
        for k in patterns:
            share, named = found.get(f"{c}|{k}") or 0.0, k.split("_")[0] in c.lower()
            if share > least or named:
                out.append({"column": c, "kind": k, "share": share, "confidence": 0.95 if share > least and named else 0.85 if share > least else 0.75})
        plain = c.lower().replace(" ", "_")
        out += [{"column": c, "kind": k, "share": 0.0, "confidence": 0.75} for k, words in (KEYWORDS if patterns is PERSONAL else {}).items() if any(w in plain for w in words)]
    return sorted(out, key=lambda x: (-x["confidence"], x["column"], x["kind"]))


def personal_inside(df: DataFrame, columns: list[str] | None = None, patterns: dict[str, str] | None = None) -> DataFrame:
    """``column, kind, values, times``: how many values hold personal data
    anywhere in them, and how often; all columns and kinds in one aggregation.
    A pattern is not found within a longer run of digits or letters."""
    patterns, cols = patterns or PERSONAL, columns or string_columns(df)
    cells = [F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind"), F.regexp_count(F.col(c), F.lit(rf"\b(?:{p})\b")).alias("n")) for c in cols for k, p in patterns.items()]
    return df.select(F.inline(F.array(*cells))).groupBy("column", "kind").agg(F.count_if(F.col("n") > 0).alias("values"), F.coalesce(F.sum("n"), F.lit(0)).alias("times"))
