"""Quality rules, line first: rules per line, failing lines go, documents that lose too much text are rejected.

Everything is column expressions over one row, so nothing is shuffled and one long or frequent document or source
costs no more than its own text. Cases:

* NULL or empty text: no words, hence ``base_failed`` and not kept.
* Lines without a word count neither as lines nor as repeats; the cleaned text keeps them where they stand.
* Ties and repeated rows: every row is judged by its own text alone.
* Further columns, whatever their names, pass through ``keep_documents`` unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import SPACE, packed, query, table, text_or_empty, words

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"
SEPARATORS = r"[|\x{2022}\x{00B7}\x{203A}\x{00BB}]"
UPPER = r"[A-Z\x{00C0}-\x{00D6}\x{00D8}-\x{00DE}]"
LOWER = r"[a-z\x{00DF}-\x{00F6}\x{00F8}-\x{00FF}]"
#: Marks of punctuation, ASCII and the usual others.
MARKS = r"[!-/:-@\[-\x60{-~\x{00A1}\x{00AB}\x{00B7}\x{00BB}\x{00BF}\x{2010}-\x{2027}\x{2030}-\x{205E}\x{3001}-\x{3003}]"
#: Fixed phrases of page furniture in English, French, German and Spanish; a short line that holds one is boilerplate.
PHRASES = {
    "en": "all rights reserved|terms of (use|service)|privacy policy|cookie policy|accept (all )?cookies|uses cookies|enable javascript|"
    "javascript (is|must be) (disabled|enabled)|click here|read more|sign (in|up) |log ?in to|subscribe to|share (this|on) |back to top|"
    "skip to (main )?content|lorem ipsum|forgot (your )?password|add to (cart|basket)|leave a (comment|reply)|powered by |follow us on",
    "fr": "tous droits r\u00e9serv\u00e9s|conditions d'utilisation|mentions l\u00e9gales|politique de (confidentialit\u00e9|cookies)|accepter (tous )?les cookies|utilise des cookies|"
    "activer javascript|cliquez ici|lire la suite|en savoir plus|se connecter|s'inscrire|abonnez-vous|partager sur |retour en haut|aller au contenu|mot de passe oubli\u00e9|ajouter au panier|laisser un commentaire",
    "de": "alle rechte vorbehalten|nutzungsbedingungen|datenschutzerkl\u00e4rung|cookie-richtlinie|alle cookies akzeptieren|verwendet cookies|javascript aktivieren|klicken sie hier|"
    "hier klicken|weiterlesen|mehr erfahren|jetzt anmelden|newsletter abonnieren|teilen auf |nach oben|zum inhalt springen|passwort vergessen|in den warenkorb|kommentar hinterlassen",
    "es": "todos los derechos reservados|t\u00e9rminos de (uso|servicio)|aviso legal|pol\u00edtica de (privacidad|cookies)|aceptar (todas )?las cookies|utiliza cookies|activar javascript|"
    "haga clic aqu\u00ed|haz clic aqu\u00ed|leer m\u00e1s|seguir leyendo|iniciar sesi\u00f3n|reg\u00edstrate|suscr\u00edbete|compartir en |volver arriba|ir al contenido|a\u00f1adir al carrito|deja un comentario",
}
BOILERPLATE = r"(?i)(^|[\x20\x09\x22'(\[>|/-])(" + "|".join(PHRASES.values()) + ")"


@dataclass(frozen=True)
class Rules:
    """Limits of the line rules and of the document's verdict."""

    symbols_per_word: float = 0.5
    marks_share: float = 0.5
    words_per_separator: int = 4
    shouting_words: int = 3
    repeat_words: int = 10
    distinct_share: float = 0.4
    boilerplate_words: int = 12
    lost_share: float = 0.5
    least_words: int = 20
    repeat_percent: int = 30


def count_of(text: Column, kind: str) -> Column:
    """Characters of a class in a text: what is missing once their runs are taken out."""
    return F.length(text) - F.length(F.regexp_replace(text, F.lit(f"{kind}+"), F.lit("")))


def line_fails(line: Column, rules: Rules = Rules()) -> Column:
    """Punctuation, navigation and boilerplate rules on one line."""

    def fails(x: Column) -> Column:
        w, lower = x["w"], x["lower"]
        n, chars = F.size(w), F.length(F.array_join(w, ""))
        # where half of the characters are small letters neither marks nor capitals can be more than that
        odd = 2 * lower < chars
        separators = count_of(line, SEPARATORS)
        punctuation = (count_of(line, SYMBOLS) > n * F.lit(rules.symbols_per_word)) | (odd & (count_of(line, MARKS) > chars * F.lit(rules.marks_share)))
        shouting = (n >= rules.shouting_words) & odd & (count_of(line, UPPER) > lower)
        navigation = (separators >= 2) & (separators * rules.words_per_separator >= n)
        repeating = (n >= rules.repeat_words) & (F.size(F.array_distinct(w)) < n * F.lit(rules.distinct_share))
        boilerplate = (n <= rules.boilerplate_words) & F.rlike(line, F.lit(BOILERPLATE))
        return punctuation | navigation | shouting | repeating | boilerplate

    return _once(F.struct(words(line).alias("w"), count_of(line, LOWER).alias("lower")), fails)


def repeated_words(w: Column) -> Column:
    """Words covered by windows that the text holds twice or more, from an array of words.

    Windows are compared by 64-bit hash. Only a text with a repeat pays for the sort; covered words are counted
    from the sorted starts, each start covering what the next one does not.
    """
    hashed = F.transform(w, lambda x: F.xxhash64(x))

    def windows(h: Column) -> Column:
        ids = F.sequence(F.lit(0), F.size(h) - WINDOW)
        return F.transform(ids, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    def with_hashes(h: Column) -> Column:
        return F.when(F.size(h) >= WINDOW, _once(windows(h), from_windows)).otherwise(F.lit(0))

    def from_windows(win: Column) -> Column:
        return F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0)).otherwise(_once(F.sort_array(F.transform(win, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), from_sorted))

    def from_sorted(s: Column) -> Column:
        same = lambda a, b: F.coalesce(F.get(s, a)["x"] == F.get(s, b)["x"], F.lit(False))
        marked = F.transform(s, lambda x, k: F.when(same(k, k - 1) | same(k, k + 1), x["i"]))
        return _once(F.sort_array(F.filter(marked, lambda i: i.isNotNull())), covered)

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    return _once(hashed, with_hashes)


def _once(value: Column, fn) -> Column:
    """fn(value) with the value computed once, bound by a one-element array."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def assess(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per document: ``row`` (the document), the base counts, the cleaned text and the verdict."""
    out = docs.select(packed(docs), text_or_empty().alias("t"))
    has_word = lambda x: F.rlike(x, F.lit(f"[^{SPACE}]"))
    out = out.select("row", "t", words(F.col("t")).alias("w"), F.split("t", "\n").alias("every"))
    out = out.select("*", F.filter("every", has_word).alias("lines"), F.filter("every", lambda x: ~has_word(x) | ~line_fails(x, rules)).alias("left"))
    out = out.select("*", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"), F.filter("left", has_word).alias("good"), repeated_words(F.col("w")).cast("long").alias("n_repeat_words"))
    size = lambda c: F.length(F.array_join(c, ""))
    out = out.select(
        "row",
        "n_words",
        "word_chars",
        count_of(F.col("t"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        ((F.col("n_words") < rules.least_words) | (100 * F.col("n_repeat_words") > rules.repeat_percent * F.col("n_words"))).alias("base_failed"),
        size("good").alias("kept_chars"),
        size("lines").alias("all_chars"),
        F.array_join("left", "\n").alias("clean_text"),
    )
    lost = F.col("all_chars") - F.col("kept_chars")
    return out.withColumn("kept", ~F.col("base_failed") & (lost <= F.col("all_chars") * F.lit(rules.lost_share)))


def keep_documents(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Kept documents with their failing lines removed; columns are those of ``docs``."""
    out = assess(docs, rules).where("kept")
    return out.select(*[(F.col("clean_text") if c.lower() == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


DIGEST = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]

_BP = BOILERPLATE.replace("'", "''")
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
e AS (SELECT r, i, array_to_string(w[i:i+{WINDOW - 1}], ' ') AS win FROM w, unnest(range(1, len(w) - {WINDOW - 2})) AS u(i)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM e) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, range(0, {WINDOW}) AS u(k) GROUP BY r),
l AS (SELECT r, unnest(lines) AS x FROM w),
f AS (SELECT r, x, len(list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) AS n,
    len(list_distinct(list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda y: y <> ''))) AS dn,
    len(regexp_extract_all(x, '{MARKS}')) AS ma, length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) AS ch,
    len(regexp_extract_all(x, '{SYMBOLS}')) AS sy, len(regexp_extract_all(x, '{SEPARATORS}')) AS se,
    len(regexp_extract_all(x, '{UPPER}')) AS up, len(regexp_extract_all(x, '{LOWER}')) AS lo FROM l),
g AS (SELECT r, sum(length(x)) AS all_chars, coalesce(sum(length(x)) FILTER (NOT (sy > n * 0.5 OR ma > ch * 0.5 OR (se >= 2 AND se * 4 >= n) OR (n >= 3 AND up > lo)
    OR (n >= 10 AND dn < n * 0.4) OR (n <= 12 AND regexp_matches(x, '{_BP}')))), 0) AS kept_chars FROM f GROUP BY r),
a AS (SELECT w.doc_id, len(w.w)::BIGINT AS n_words, length(array_to_string(w.w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '{SYMBOLS}'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(all_chars, 0) AS all_chars, coalesce(kept_chars, 0) AS kept_chars
    FROM w LEFT JOIN cov USING (r) LEFT JOIN g USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND all_chars - kept_chars <= all_chars * 0.5 AS kept FROM a
"""


@query("op7_quality_rules", ORACLE_SQL)
def op7_quality_rules(spark, sf_dir):
    return assess(table(spark, sf_dir, "documents").select("doc_id", "text")).select("row.doc_id", *DIGEST)
