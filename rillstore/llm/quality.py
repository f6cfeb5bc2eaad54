"""Quality rules, line first: rules judge each line, failing lines go, then documents that lost too much go.

A line fails as no sentence (symbols instead of words, shouting, capitals, twenty words without punctuation), as monotone, as navigation (menu words only) or as boilerplate (a phrase of site furniture or of a licence
notice that is half of the line, or stands in a short one). Words of failing lines are lost, whatever the rule.

Everything is built from DataFrame functions; nothing is shuffled, so a hot source or a very long
text costs no more than its own rows.

Defined results: a null text counts as the empty text; an empty text has no words and fails the base
rules; repeated rows are judged each on their own; an empty table gives no rows; a text or line of any length
is judged whole; extra columns are kept, whatever their names, but columns of the name of a result
column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstore.cluster import fresh

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

# Phrases of site furniture and licence notices in English, French, German and Spanish, lower case.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of service", "terms of use",
    "accept cookies", "we use cookies", "click here", "read more", "subscribe to our", "sign up for",
    "enable javascript", "is licensed under", "spdx-license-identifier", "permission is hereby granted",
    "licensed under the", "lorem ipsum", "powered by", "back to top", "skip to content",
    "tous droits réservés", "politique de confidentialité", "politique de cookies", "conditions d'utilisation",
    "mentions légales", "cliquez ici", "lire la suite", "en savoir plus", "abonnez-vous à", "inscrivez-vous à",
    "accepter les cookies", "nous utilisons des cookies", "retour en haut", "aller au contenu",
    "alle rechte vorbehalten", "datenschutzerklärung", "cookie-richtlinie", "nutzungsbedingungen",
    "hier klicken", "weiterlesen", "mehr erfahren", "newsletter abonnieren", "cookies akzeptieren",
    "wir verwenden cookies", "nach oben scrollen", "zum inhalt springen",
    "todos los derechos reservados", "política de privacidad", "política de cookies", "términos de servicio",
    "condiciones de uso", "aviso legal", "haga clic aquí", "leer más", "suscríbete a", "regístrate en",
    "aceptar cookies", "utilizamos cookies", "volver arriba", "saltar al contenido",
)
# Words of which a navigation line is made, in the same languages.
NAVIGATION = (
    "home", "about", "contact", "login", "logout", "menu", "search", "next", "previous", "prev", "share",
    "tweet", "print", "help", "faq", "sitemap", "archive", "register", "subscribe", "cart", "checkout",
    "accueil", "connexion", "déconnexion", "recherche", "suivant", "précédent", "partager", "imprimer", "aide",
    "archives", "inscription", "panier",
    "startseite", "kontakt", "anmelden", "abmelden", "menü", "suche", "weiter", "zurück", "teilen", "drucken",
    "hilfe", "archiv", "registrieren", "warenkorb", "kasse",
    "inicio", "contacto", "acceder", "salir", "menú", "buscar", "siguiente", "anterior", "compartir", "imprimir",
    "ayuda", "archivo", "registrarse", "carrito",
)
#: A boilerplate phrase, with what parts it from the word before.
PHRASE = r"(^|[^\p{L}\p{N}])(" + "|".join(BOILERPLATE) + ")"
#: Marks of which a longer line has at least one.
PUNCTUATION = "[.,!?…:;。，！？]"


@dataclass(frozen=True)
class Rules:
    """Production parameters; shares are of a line's words, but for ``max_lost`` (of a document's word characters)."""

    min_words: int = 50
    max_repeat_share: int = 50  # per cent of words in repeated windows of three
    symbol_share: int = 20  # per cent: a line with so many symbols a word fails
    shout_share: int = 30  # per cent: exclamation marks a word
    min_distinct_share: int = 25  # per cent of distinct words in a line, or window of a longer line
    window: int = 500  # words of a window over which distinct ones are judged
    monotone: int = 10  # words of a line from which on too few distinct words make it fail
    sentence: int = 20  # words of a line from which on it fails without any punctuation
    short_line: int = 8  # words of a line that one boilerplate phrase removes
    max_lost: int = 30  # per cent of word characters that failing lines may hold


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def _count(line: Column, pattern: str) -> Column:
    return F.length(line) - F.length(F.regexp_replace(line, pattern, ""))


def _monotone(words: Column, rules: Rules) -> Column:
    """Whether a line, or half of a long line's windows, has too few distinct words; that share falls with length in any text."""
    few = lambda w: F.size(F.array_distinct(w)) * 100 < F.size(w) * rules.min_distinct_share
    n = F.size(words)
    last = n - rules.window  # the last window overlaps the one before it
    starts = F.array_union(F.sequence(F.lit(0), last, F.lit(rules.window)), F.array(last))
    failing = F.transform(F.array(starts), lambda xs: F.size(F.filter(xs, lambda i: few(F.slice(words, i + 1, rules.window)))) * 2 >= F.size(xs))[0]
    return F.when(n <= rules.window, few(words)).otherwise(failing)


def is_boilerplate(line: Column, words: Column, rules: Rules) -> Column:
    """Whether phrases of site furniture or licence notices make up half of a line, or stand in a short one."""
    low = F.lower(line)
    phrases = F.length(low) - F.length(F.regexp_replace(low, PHRASE, ""))
    return low.rlike(PHRASE) & ((F.size(words) <= rules.short_line) | (phrases * 2 >= F.length(F.trim(low))))


def line_failures(line: Column, words: Column, rules: Rules) -> Column:
    """Whether a line is no sentence, monotone, navigation or boilerplate."""
    n = F.size(words)
    marks = (_count(line, SYMBOLS) * 100 >= n * rules.symbol_share) | (_count(line, "!") * 100 >= n * rules.shout_share)
    capitals = (line == F.upper(line)) & (line != F.lower(line))
    monotone, endless = (n >= rules.monotone) & _monotone(words, rules), (n >= rules.sentence) & ~line.rlike(PUNCTUATION)
    navigation = F.forall(words, lambda w: F.lower(F.regexp_replace(w, r"[\p{P}\p{S}]", "")).isin("", *NAVIGATION))
    return ((n >= 3) & (marks | capitals)) | monotone | endless | ((n >= 2) & navigation) | is_boilerplate(line, words, rules)


def _repeat_words(words: Column, n: Column, bits: int = 24) -> Column:
    """Words covered by windows of three that occur twice or more in the same text.

    Windows are sorted by a hash with the place behind it, so that equals become neighbours. Neighbours count
    only if their words are equal; where a neighbour has the same hash for other words, the whole run of
    that hash is looked through. Texts of up to ``2 ** bits`` words keep hash and place in one number.
    """
    at = F.sequence(F.lit(0), n - 3)
    window = lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2])

    def same(p: Column, q: Column) -> Column:
        return (words[p] == words[q]) & (words[p + 1] == words[q + 1]) & (words[p + 2] == words[q + 2])

    def repeated(sorted_: Column, head, place) -> Column:
        """Places of repeated windows, in order."""
        no = F.lit(False)
        like = lambda x, y: F.coalesce(head(x) == head(y), no)

        def twice(xs: Column, x: Column, i: Column) -> Column:
            a, b = F.get(xs, i - 1), F.get(xs, i + 1)
            near = (like(x, a) & same(place(x), place(a))) | (like(x, b) & same(place(x), place(b)))
            return (like(x, a) | like(x, b)) & (near | F.exists(xs, lambda y: like(x, y) & (place(x) != place(y)) & same(place(x), place(y))))

        # Bound outside the lambdas, so that the sorted array is made once.
        return F.transform(F.array(sorted_), lambda xs: F.sort_array(F.transform(F.filter(xs, lambda x, i: twice(xs, x, i)), place)))[0]

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    packed = F.sort_array(F.transform(at, lambda i: F.shiftleft(window(i), bits).bitwiseOR(i.cast("long"))))
    short = repeated(packed, lambda x: F.shiftright(x, bits), lambda x: x.bitwiseAND(F.lit((1 << bits) - 1)).cast("int"))
    pairs = F.sort_array(F.transform(at, lambda i: F.struct(window(i).alias("h"), i.alias("p"))))
    long = repeated(pairs, lambda x: x["h"], lambda x: x["p"])
    return F.when(n < 3, F.lit(0).cast("long")).otherwise(F.transform(F.array(F.when(n <= (1 << bits), short).otherwise(long)), covered)[0])


NEW = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "lost_words", "n_lines_removed", "clean_text", "kept")


def _judged(docs: DataFrame, rules: Rules) -> tuple[DataFrame, str]:
    """``docs`` with a column of an unused name that holds the columns of ``NEW``.

    It is laid out from a list of one, below which no filter is moved: else a filter on the verdict would
    work out all its parts again, for every word.
    """
    own = {k: fresh(docs, f"op_{k}") for k in ("words", "lines", "worded", "n", "failing", "repeats", "result")}
    col = {k: F.col(v) for k, v in own.items()}
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumn(own["words"], words_of(text)).withColumn(own["lines"], F.split(text, "\n"))
    d = d.withColumns({own["n"]: F.size(col["words"]), own["worded"]: F.filter(col["lines"], lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    # Of every line its text if it stays, else null, with the words and their characters that go with it.
    judged = lambda x: F.transform(
        F.array(words_of(x)),
        lambda w: F.transform(
            F.array((F.size(w) > 0) & line_failures(x, w, rules)),
            lambda bad: F.struct(F.when(~bad, x).alias("line"), F.when(bad, F.size(w)).otherwise(0).alias("words"), F.when(bad, F.length(F.array_join(w, ""))).otherwise(0).alias("chars")),
        )[0],
    )[0]
    d = d.withColumns({own["failing"]: F.transform(col["lines"], judged), own["repeats"]: _repeat_words(col["words"], col["n"])})
    total = lambda k: F.aggregate(col["failing"], F.lit(0).cast("long"), lambda a, x: a + x[k])
    chars = F.length(F.array_join(col["words"], "")).cast("long")
    base = (col["n"] < rules.min_words) | (col["repeats"] * 100 > col["n"] * rules.max_repeat_share)
    new = {
        "n_words": col["n"].cast("long"),
        "word_chars": chars,
        "n_symbols": _count(text, SYMBOLS).cast("long"),
        "n_dup_lines": (F.size(col["worded"]) - F.size(F.array_distinct(col["worded"]))).cast("long"),
        "n_repeat_words": col["repeats"],
        "base_failed": base,
        "lost_chars": total("chars"),
        "lost_words": total("words"),
        "n_lines_removed": F.size(F.filter(col["failing"], lambda x: x["line"].isNull())).cast("long"),
        "clean_text": F.array_join(F.transform(F.filter(col["failing"], lambda x: x["line"].isNotNull()), lambda x: x["line"]), "\n"),
        "kept": ~base & (total("chars") * 100 <= chars * rules.max_lost) & (col["n"] - total("words") >= rules.min_words),
    }
    return d.withColumn(own["result"], F.explode(F.array(F.struct(*[c.alias(k) for k, c in new.items()])))), own["result"]


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``docs`` with its figures, the cleaned text (``clean_text``) and the verdict (``kept``).

    Needs a ``text`` column. A document is rejected when it fails the base rules, when failing lines hold more
    than ``max_lost`` per cent of its word characters, or when fewer than ``min_words`` words stay.
    ``lost_words`` and ``lost_chars`` are those of failing lines, and ``clean_text`` lacks these lines.
    """
    rest = [c for c in docs.columns if c.lower() not in NEW]
    d, result = _judged(docs, rules)
    return d.select(*[F.col(f"`{c}`") for c in rest], f"{result}.*")


def clean(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The kept rows of ``docs``, with the cleaned text as ``text``; all other columns as they are."""
    d, result = _judged(docs, rules)
    text = F.col(result)["clean_text"]
    return d.filter(F.col(result)["kept"]).select(*[text.alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns])


RESULT = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "lost_words", "n_lines_removed", "kept")

ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents
), c AS (
  SELECT doc_id, text, w, lines, len(w) AS n, list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS worded FROM d
), win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, n - 1)) AS i FROM c WHERE n >= 3)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM win) WHERE k > 1
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id
), line AS (
  SELECT doc_id, x, list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda y: y <> '') AS v FROM (SELECT doc_id, unnest(lines) AS x FROM c)
), low AS (SELECT doc_id, x, v, lower(x) AS y, length(lower(x)) - length(regexp_replace(lower(x), '@phrase', '', 'g')) AS phrases FROM line WHERE len(v) > 0
), verdict AS (
  SELECT doc_id, length(array_to_string(v, '')) AS chars, len(v) AS n,
    (len(v) >= 3 AND (length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) * 100 >= len(v) * @symbols OR length(regexp_replace(x, '[^!]', '', 'g')) * 100 >= len(v) * @shout))
    OR (x = upper(x) AND x <> y AND len(v) >= 3)
    OR (len(v) >= @sentence AND NOT regexp_matches(x, '@punctuation'))
    OR (len(v) >= @monotone AND len(v) <= @window AND len(list_distinct(v)) * 100 < len(v) * @distinct)
    OR (len(v) > @window AND len(list_filter(list_distinct(list_concat(range(0, len(v) - @window + 1, @window), [len(v) - @window])), lambda s: len(list_distinct(v[s + 1:s + @window])) * 100 < @window * @distinct)) * 2
        >= len(list_distinct(list_concat(range(0, len(v) - @window + 1, @window), [len(v) - @window]))))
    OR (len(v) >= 2 AND len(list_filter(v, lambda z: NOT lower(regexp_replace(z, '[\p{P}\p{S}]', '', 'g')) IN ('', @navigation))) = 0)
    OR (phrases > 0 AND (len(v) <= @short OR phrases * 2 >= length(trim(y)))) AS bad
  FROM low
), lost AS (
  SELECT doc_id, CAST(coalesce(sum(chars) FILTER (WHERE bad), 0) AS BIGINT) AS lost_chars, CAST(coalesce(sum(n) FILTER (WHERE bad), 0) AS BIGINT) AS lost_words, count(*) FILTER (WHERE bad) AS n_lines_removed FROM verdict GROUP BY doc_id
), f AS (
  SELECT c.doc_id, CAST(n AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(worded) - len(list_distinct(worded)) AS BIGINT) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost_chars, 0) AS lost_chars, coalesce(lost_words, 0) AS lost_words, coalesce(n_lines_removed, 0) AS n_lines_removed
  FROM c LEFT JOIN rep ON rep.doc_id = c.doc_id LEFT JOIN lost ON lost.doc_id = c.doc_id
), b AS (SELECT *, n_words < @min_words OR n_repeat_words * 100 > n_words * @max_repeat AS base_failed FROM f)
SELECT *, NOT base_failed AND lost_chars * 100 <= word_chars * @max_lost AND n_words - lost_words >= @min_words AS kept FROM b
"""
for _k, _v in {
    "@symbols": Rules.symbol_share, "@shout": Rules.shout_share, "@distinct": Rules.min_distinct_share, "@min_words": Rules.min_words, "@max_repeat": Rules.max_repeat_share,
    "@max_lost": Rules.max_lost, "@window": Rules.window, "@sentence": Rules.sentence, "@monotone": Rules.monotone, "@short": Rules.short_line,
    "@navigation": ", ".join(f"'{x}'" for x in NAVIGATION), "@phrase": PHRASE.replace("'", "''"), "@punctuation": PUNCTUATION,
}.items():
    ORACLE = ORACLE.replace(_k, str(_v))
