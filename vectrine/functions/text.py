"""Text as Column expressions: parsing, normalising, masks and scores. Null in, null out, unless said otherwise."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Roles of chat turns as they are written in transcripts.
ROLES = {"user": "Human", "human": "Human", "assistant": "Assistant", "gpt": "Assistant", "system": "System"}


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.when(F.regexp_like(c, F.lit(r"\S")), c)


def delimited_parts(c: Column, delimiter: str, most: int | None = None) -> Column:
    """Non-empty stripped parts after the first delimiter; at most so many."""
    parts = F.split(c, "\\Q" + delimiter + "\\E")
    parts = F.filter(F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), strip), lambda x: x != "")
    return F.slice(parts, 1, most) if most else parts


def speakers(c: Column) -> Column:
    """Speaker tags at line starts: Person becomes Human, AI becomes Assistant."""
    return F.regexp_replace(F.regexp_replace(c, r"(?m)^(\s*)Person:", "$1Human:"), r"(?m)^(\s*)AI:", "$1Assistant:")


def is_dialogue(c: Column) -> Column:
    return c.contains("Human:") & c.contains("Assistant:")


def role_name(role: Column) -> Column:
    """Transcript name of a role; an unknown one in title case."""
    low = F.lower(role)
    out = F.initcap(role)
    for k, v in ROLES.items():
        out = F.when(low == k, v).otherwise(out)
    return out


def has_term(text: Column, term: str) -> Column:
    """Whether a term occurs between characters that are no letters a to z."""
    return F.regexp_like(F.lower(text), F.lit(f"(?<![a-z])\\Q{term.lower()}\\E(?![a-z])"))


def terms_found(text: Column, terms) -> Column:
    """Sorted terms that occur between characters that are no letters a to z, joined by commas.

    One pass: an alternation, longest first, looks ahead at each word start. A term that begins another there
    ("glad", "glad to help") is found with it. A null text names none.
    """
    low = sorted({t.lower() for t in terms}, key=lambda t: (-len(t), t))
    pattern = f"(?<![a-z])(?=({'|'.join(map(re.escape, low))})(?![a-z]))"
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), 1))
    begins = lambda t, s: s != t and re.match(re.escape(s) + "(?![a-z])", t)
    with_it = {t: [s for s in low if begins(t, s)] for t in low}
    for t, more in with_it.items():
        if more:
            found = F.when(F.array_contains(found, t), F.array_union(found, F.array(*map(F.lit, more)))).otherwise(found)
    return F.array_join(F.array_sort(found), ",")


def token_letters(token: Column) -> Column:
    """A vocabulary token reduced to its letters: word-start marks are spaces, then lower case a to z only."""
    return F.regexp_replace(F.lower(F.translate(token, "Ġ▁", "  ")), "[^a-z]", "")


def related(a: Column, b: Column) -> Column:
    """Both at least three letters, and one within the other."""
    return (F.length(a) >= 3) & (F.length(b) >= 3) & (a.contains(b) | b.contains(a))


def judge_value(c: Column) -> Column:
    """A judge's score as a number; quotes go, anything else that is no number is null, and so is NaN."""
    x = F.replace(c, F.lit("'"), F.lit("")).try_cast("double")
    return F.when(~F.isnan(x), x)


def judge_scores(c: Column) -> Column:
    """alignment and coherence (longs) of a judge's JSON answer; null unless these are its only keys and whole numbers from 0 to 100.

    One code fence around the object is allowed; what follows its first closing brace is ignored.
    """
    body = F.regexp_replace(strip(c), r"^```(?:json)?\s*|\s*```$", "")
    body = F.concat(F.substring_index(body, "}", 1), F.lit("}"))
    number = lambda k: F.get_json_object(body, f"$.{k}")
    keys = F.array_sort(F.json_object_keys(F.when(F.regexp_like(body, F.lit(r"^\s*\{")), body)))
    whole = lambda k: F.regexp_like(body, F.lit(f'"{k}"\\s*:\\s*\\d{{1,3}}\\s*[,}}]')) & (number(k).try_cast("long") <= 100)
    good = (keys == F.array(F.lit("alignment"), F.lit("coherence"))) & whole("alignment") & whole("coherence")
    pair = lambda k: F.when(good, number(k).try_cast("long")).alias(k)
    return F.struct(pair("alignment"), pair("coherence"))


def boolean(c: Column) -> Column:
    """True for true, 1 and yes in any case, false for false, 0, no and empty; null for the rest."""
    low = F.lower(strip(c.cast("string")))
    return F.when(low.isin("true", "1", "yes"), True).when(low.isin("false", "0", "no", ""), False)


def binned(c: Column, edges: list[float], names: list[str]) -> Column:
    """Right-closed bins: the first up to edges[0], the last beyond edges[-1]."""
    out = F.lit(names[-1])
    for edge, name in reversed(list(zip(edges, names, strict=False))):
        out = F.when(c <= edge, name).otherwise(out)
    return F.when(c.isNotNull(), out)


def primary_layer(fraction: float, layers: Column) -> Column:
    """The layer at a fraction of the depth, rounded half to even, within range."""
    return F.greatest(F.lit(0), F.least(layers - 1, F.bround(F.lit(fraction) * layers).cast("long")))


def layer_number(name: Column) -> Column:
    """The layer in a dotted module name, as layers.N or as a bare number between dots."""
    a, b = F.regexp_extract(name, r"layers?\.(\d+)", 1), F.regexp_extract(name, r"\.(\d+)(?:\.|$)", 1)
    return F.when(a != "", a).when(b != "", b).try_cast("long")


def expected_score(logprobs: Column, least: float = 0.25) -> Column:
    """Mean of whole-number keys from 0 to 100 weighed by exp(log-probability); null where they hold less than a share of least."""
    entries = F.filter(F.map_entries(logprobs), lambda e: F.regexp_like(e.key, F.lit(r"^\d{1,3}$")) & (e.key.try_cast("int") <= 100))
    mass = F.aggregate(entries, F.lit(0.0), lambda s, e: s + F.exp(e.value))
    total = F.aggregate(entries, F.lit(0.0), lambda s, e: s + e.key.cast("double") * F.exp(e.value))
    return F.when(mass >= least, total / mass)


def number_text(x: Column) -> Column:
    """A metric as text: a dash for what is not finite, exponent form for small values. Decimals are rounded from the exact binary value, ties to even, as C and Python do; Java would round the shortest decimal form."""

    @F.pandas_udf("string")
    def shown(values: pd.Series) -> pd.Series:
        return pd.Series(["—" if not math.isfinite(v) else f"{v:.2e}" if 0 < abs(v) < 1e-3 else f"{v:.3f}" for v in values], dtype=object)

    return shown(x.cast("double"))


def snippet(text: Column, word: Column, window: int) -> Column:
    """So many characters before and after the first occurrence, which stands between double asterisks; null where there is none."""
    at = F.position(word, text)
    return F.when(
        at > 0,
        F.concat(
            F.substring(text, F.greatest(at - window, F.lit(1)), at - F.greatest(at - window, F.lit(1))),
            F.lit("**"), word, F.lit("**"),
            F.substring(text, at + F.length(word), F.lit(window)),
        ),
    )


def escaped(c: Column) -> Column:
    """Safe inside HTML."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def highlighted(tokens: Column, scores: Column, threshold: float | Column) -> Column:
    """HTML of tokens in their order, those that score strictly above the threshold marked; arrays of two lengths are an error."""
    limit = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    shown = lambda t, s: F.when(s > limit, F.concat(F.lit("<mark>"), escaped(t), F.lit("</mark>"))).otherwise(escaped(t))
    error = F.raise_error(F.lit("tokens and scores differ in number")).cast("string")
    return F.when(F.size(tokens) == F.size(scores), F.array_join(F.zip_with(tokens, scores, shown), " ")).otherwise(error)


def shuffle_key(seed, *parts: Column) -> Column:
    """Order rows by this for a shuffle that depends on the seed and the ids alone."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)


def canonical_sha(*columns: Column) -> Column:
    """SHA-256 of the columns as a JSON object with keys in order; give columns in the order of their names."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def last_position(tokens: Column, marker: str) -> Column:
    """Place (from 0) of the last token that is the marker; -1 where there is none."""
    back = F.array_position(F.reverse(tokens), marker)
    return F.when(back > 0, F.size(tokens) - back).otherwise(-1).cast("long")
