"""Queries over the driver's tables, one or more for each operator, and the SQL that gives the same rows.

Part names serve as roots (a space becomes the boundary `_`), brands as glosses, documents' words as forms to parse.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphlake.functions.rules import make_rule, rewritten
from morphlake.functions.symbols import decoded, encoded, feature_key, feature_key_column
from morphlake.operators import automata, edit, paradigm, reports, resolution
from morphlake.sources import lexicon as lex
from morphlake.sources.grammar import Grammar
from morphlake.sources.tables import stored

VOWELS = "aeiou"
CONSONANTS = "bcdfghjklmnpqrstvwxyz"
LETTERS = VOWELS + CONSONANTS


def demo_grammar() -> Grammar:
    """Nouns with number and case over plain letters: a rule in the plural, and a contingent genitive plural."""
    suffix = lambda v, stage="suffix": {"kind": "suffix", "value": v, "stage": stage}
    files = {
        "Inventory": {"letters": {"kind": "Inventory", "data": [{"ref": "<V>", "phones": list(VOWELS)}, {"ref": "<C>", "phones": list(CONSONANTS)}]}},
        "Patterns": {"shapes": {"kind": "Patterns", "patterns": [{"ref": "<Short>", "pattern": "<C><V><C>_<Sigma>*"}, {"ref": "<Open>", "pattern": "<Sigma>*<V>#"}]}},
        "Rules": {"rules": {"kind": "Rules", "rules": [
            {"name": "widen", "input_pattern": "o", "output_pattern": "au", "left_context": "<C>"},
            {"name": "swap", "string_map": [["a", "e"], ["e", "a"], ["i", "o"]], "right_context": "<C>"},
            {"name": "drop", "input_pattern": "l", "output_pattern": None, "right_context": "l|d"},
            {"name": "insert", "input_pattern": None, "output_pattern": "e", "left_context": "t", "right_context": "#"},
            {"name": "chain", "rule_sequence": ["$drop", "$widen"]},
        ]}},
        "PartOfSpeech": {"noun": {"kind": "PartOfSpeech", "name": "noun", "features": ["number", "case"], "lexical_features": ["p_type"], "principal_parts": []}},
        "FeatureDefinitions": {"noun": {"kind": "FeatureDefinitions", "features": {"number": ["sg", "pl"], "case": ["nom", "gen"]}}},
        "FeatureMarkers": {
            "number": {"kind": "FeatureMarkers", "feature": "number", "markers": {"sg": None, "pl": [suffix("-s"), {"kind": "rule", "value": "$widen", "stage": "vowels"}]}},
            "case": {"kind": "FeatureMarkers", "feature": "case", "markers": {"nom": None, "gen": [suffix("-n", "outer")]}},
        },
        "ContingentFeatureMarkers": {"gen_pl": {"kind": "ContingentFeatureMarkers", "features": ["number", "case"], "markers": [{"features": {"number": "pl", "case": "gen"}, "realization": [suffix("-n")]}]}},
        "Paradigm": {"noun": {"kind": "Paradigm", "part_of_speech": "$noun", "feature_markers": {"number": "$number", "case": "$case"}, "stage_order": ["vowels", "suffix", "outer"], "contingent_markers": ["$gen_pl"]}},
    }
    return Grammar("", files)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """root, gloss, p_type, p_partkey of all parts."""
    return table(spark, sf_dir, "part").select(F.translate("p_name", " ", "_").alias("root"), F.col("p_brand").alias("gloss"), "p_type", "p_partkey")


KEY = ("0123456789", "bcdfghklmn")


def keyed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """root, gloss, p_type, p_partkey: a root of its own for each part, so that a lexicon grows with the data."""
    root = F.concat(F.translate(F.col("p_partkey").cast("string"), *KEY), F.lit("_"), F.translate("p_name", " ", "_"))
    return table(spark, sf_dir, "part").select(root.alias("root"), F.col("p_brand").alias("gloss"), "p_type", "p_partkey")


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select("root").distinct()


ROOTS_SQL = "SELECT DISTINCT replace(p_name, ' ', '_') AS root FROM part"


def lexicon_roots(spark, sf_dir):
    return lex.roots(keyed_words(spark, sf_dir)).unionByName(lex.roots(words(spark, sf_dir))).groupBy("root").agg(F.count("*").alias("n"))


def gloss_roots(spark, sf_dir):
    return lex.with_gloss(words(spark, sf_dir), "Brand#7").groupBy("root").agg(F.count("*").alias("n"))


def lexical_feature_filter(spark, sf_dir):
    return lex.with_features(table(spark, sf_dir, "part"), {"p_type": "PROMO", "p_brand": "Brand#3"}).select("p_partkey", "p_name")


def first_row_lookup(spark, sf_dir):
    return lex.first_rows(words(spark, sf_dir), "p_partkey").select("root", "gloss", "p_type")


def principal_part_fallback(spark, sf_dir):
    blank = words(spark, sf_dir).withColumn("stem", F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1, F.lower("gloss")))
    return lex.principal_part(blank, "stem").groupBy("root", "stem").agg(F.count("*").alias("n"))


def paradigm_roots(spark, sf_dir):
    g = demo_grammar()
    g.files["Paradigm"]["noun"]["filter"] = {"lexical_features": {"p_type": "SMALL"}, "pattern": "<C>+<V><C>_<Sigma>*"}
    return paradigm.Paradigm(g, "noun").roots(words(spark, sf_dir)).groupBy("root").agg(F.count("*").alias("n"))


def pattern_filter(spark, sf_dir):
    g = demo_grammar()
    pattern = "(<C>?<C>|{^aeiou_}<Phone>)<V>+<C>*_{bgrw}<Sigma>*"
    return roots(spark, sf_dir).where(g.patterns.matches(encoded(g.symbols, F.col("root")), pattern))


def pattern_test(spark, sf_dir):
    g = demo_grammar()
    own = roots(spark, sf_dir)
    cases = own.select(F.lit("<Short>").alias("ref"), F.col("root").alias("string"), F.when(F.substring("root", 4, 1) == "_", "include").otherwise("exclude").alias("test_kind"))
    cases = cases.unionByName(own.select(F.lit("<Open>").alias("ref"), F.col("root").alias("string"), F.lit("exclude").alias("test_kind")))
    return reports.test_patterns(g, cases).groupBy("ref").agg(F.every("pass").alias("all_pass"), F.count_if("pass").alias("n_pass"), F.count("*").alias("n"))


def _ruled(name, grammar=None):
    def run(spark, sf_dir):
        g = grammar or demo_grammar()
        s = g.symbols
        rows = roots(spark, sf_dir).withColumn("code", F.concat(F.lit(s.bow), encoded(s, F.col("root")), F.lit(s.eow)))
        return rows.select("root", F.explode(rewritten(g.rules(name), F.col("code"))).alias("code")).select("root", decoded(s, F.col("code")).alias("form"))

    return run


def rewrite_many(spark, sf_dir):
    """A rule with two outputs, by the general procedure."""
    g = demo_grammar()
    s = g.symbols
    rule = make_rule(g.patterns, [("g", "{gk}")], None, "<V>")
    rows = roots(spark, sf_dir).withColumn("code", F.concat(F.lit(s.bow), encoded(s, F.col("root")), F.lit(s.eow)))
    return rows.select("root", F.explode(rewritten([rule], F.col("code"))).alias("code")).select("root", decoded(s, F.col("code")).alias("form"))


def rule_test(spark, sf_dir):
    cases = roots(spark, sf_dir).select(F.col("root").alias("input"), F.when(F.col("root").contains("rod"), F.replace("root", F.lit("rod"), F.lit("raud"))).otherwise(F.col("root")).alias("expected"))
    out = reports.run_rule(demo_grammar(), "$widen", cases)
    return out.select("input", "expected", F.element_at("output", 1).alias("output"), "pass")


def feature_combos(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return resolution.feature_combos([orders.select(F.col(c).alias(a)).distinct().unionByName(spark.createDataFrame([("unmarked",)], f"{a} string")) for c, a in (("o_orderpriority", "priority"), ("o_orderstatus", "status"))])


def _marker_tables(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus").distinct()
    cells = orders.select(F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("cell"), F.create_map(F.lit("priority"), "o_orderpriority", F.lit("status"), "o_orderstatus").alias("bundle"))
    contingent = spark.createDataFrame(
        [("c1", ["priority", "status"], 0, {"priority": "1-URGENT", "status": "F"}, 0, "uf"), ("c1", ["priority", "status"], 1, {"priority": "1-URGENT"}, 0, "u"), ("c1", ["priority", "status"], 1, {"priority": "1-URGENT"}, 1, "u2"), ("c2", ["status"], 0, {"status": "P"}, 0, "p")],
        "file string, features array<string>, ord int, pattern map<string,string>, pos int, marker string",
    )
    regular = spark.createDataFrame([("r1", "priority", p, 0, p[:1]) for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")] + [("r2", "status", v, 0, v.lower()) for v in "FOP"], "file string, feature string, value string, pos int, marker string")
    return cells, contingent, regular


def marker_resolution(spark, sf_dir):
    return resolution.resolve_markers(*_marker_tables(spark, sf_dir))


def unexpressed_features(spark, sf_dir):
    return resolution.unexpressed(*_marker_tables(spark, sf_dir))


def stage_order(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.substring("o_orderpriority", 3, 20).alias("stage"))
    rank = resolution.stage_rank(F.col("stage"), ["HIGH", "URGENT", "LOW"])
    return orders.select("o_orderkey", "stage", rank.alias("stage_rank"))


def relation(spark, sf_dir) -> DataFrame:
    return paradigm.inflected(spark, demo_grammar(), "noun", words(spark, sf_dir))


def keyed_relation(spark, sf_dir) -> DataFrame:
    return paradigm.inflected(spark, demo_grammar(), "noun", keyed_words(spark, sf_dir))


def inflect_table(spark, sf_dir):
    return keyed_relation(spark, sf_dir).select("paradigm", "root", "feature_key", "form", "form_tagged")


def verb_grammar() -> Grammar:
    """Verbs with every kind of marker: prefixes, suffixes, replacement, suppletion and principal parts with tags; a fixed feature, a global marker, a filter by a named pattern."""
    files = {
        "Inventory": {"letters": {"kind": "Inventory", "data": [{"ref": "<V>", "phones": list(VOWELS)}, {"ref": "<C>", "phones": list(CONSONANTS)}, {"ref": "<T>", "tags": ["[hard]"]}]}},
        "Patterns": {"shapes": {"kind": "Patterns", "patterns": [{"ref": "<Keyed>", "pattern": "<Key>_<Sigma>*"}, {"ref": "<Key>", "pattern": "<C>+"}]}},
        "PartOfSpeech": {"verb": {"kind": "PartOfSpeech", "name": "verb", "features": ["voice", "tense", "person"], "lexical_features": ["p_type"], "principal_parts": ["weak"]}},
        "FeatureDefinitions": {"verb": {"kind": "FeatureDefinitions", "features": {"voice": ["active"], "tense": ["pres", "past", "perf"], "person": ["one", "two", "three"]}}},
        "FeatureMarkers": {
            "tense": {"kind": "FeatureMarkers", "feature": "tense", "markers": {"pres": None, "past": [{"kind": "prefix", "value": "ge_", "stage": "outer"}], "perf": [{"kind": "replace", "value": ["_", "<Empty>"], "stage": "inner"}]}},
            "person": {"kind": "FeatureMarkers", "feature": "person", "markers": {"one": [{"kind": "suffix", "value": "-m"}], "two": [{"kind": "principal_part", "value": "weak"}, {"kind": "suffix", "value": "-t"}], "three": [{"kind": "suppletion", "value": "zu", "stage": "inner"}]}},
        },
        "Paradigm": {"verb": {"kind": "Paradigm", "part_of_speech": "$verb", "feature_markers": {"voice": "active", "tense": "$tense", "person": "$person"}, "global_markers": [{"kind": "suffix", "value": "q"}], "global_stage": None, "stage_order": ["inner", "outer"], "filter": {"lexical_features": {"p_type": "PROMO"}, "pattern": "<Keyed>"}}},
    }
    return Grammar("", files)


def inflect_verbs(spark, sf_dir):
    weak = F.when(F.col("p_partkey") % 3 != 0, F.concat("root", F.lit("[hard]e"))).otherwise("")
    return paradigm.inflected(spark, verb_grammar(), "verb", keyed_words(spark, sf_dir).withColumn("weak", weak)).select("root", "feature_key", "form", "form_tagged")


def mixed_grammar() -> Grammar:
    """Contingent markers, a principal part, markers that inherit, and stages of files and paradigms, in one paradigm."""
    suffix = lambda v, **more: {"kind": "suffix", "value": v, **more}
    files = {
        "Inventory": {"letters": {"kind": "Inventory", "data": [{"ref": "<L>", "phones": list(LETTERS)}]}},
        "PartOfSpeech": {"noun": {"kind": "PartOfSpeech", "name": "noun", "features": ["number", "case"], "lexical_features": [], "principal_parts": ["weak"]}},
        "FeatureDefinitions": {"noun": {"kind": "FeatureDefinitions", "features": {"number": ["sg", "pl"], "case": ["nom", "gen", "dat"]}}},
        "FeatureMarkers": {
            "number": {"kind": "FeatureMarkers", "feature": "number", "markers": {"sg": None, "pl": [suffix("-s"), {"kind": "principal_part", "value": "weak"}]}},
            "plain": {"kind": "FeatureMarkers", "feature": "case", "markers": {"nom": None, "gen": [suffix("-n")], "dat": [suffix("-m")]}},
            "case": {"kind": "FeatureMarkers", "feature": "case", "inherits": "$plain", "global_stage": "last", "markers": {"gen": [{"kind": "prefix", "value": "ge_"}]}},
        },
        "ContingentFeatureMarkers": {"gen_pl": {"kind": "ContingentFeatureMarkers", "features": ["number", "case"], "markers": [{"features": {"number": "pl", "case": "gen"}, "realization": [suffix("-x"), {"kind": "replace", "value": ["_", "a"], "stage": "inner"}]}]}},
        "Paradigm": {"noun": {"kind": "Paradigm", "part_of_speech": "$noun", "feature_markers": {"number": "$number", "case": "$case"}, "stage_order": ["inner", "outer", "last"], "global_stage": "outer", "global_markers": [suffix("q", stage="last")], "contingent_markers": ["$gen_pl"]}},
    }
    return Grammar("", files)


def inflect_mixed(spark, sf_dir):
    weak = F.when(F.col("p_partkey") % 3 != 0, F.concat("root", F.lit("e"))).otherwise("")
    return paradigm.inflected(spark, mixed_grammar(), "noun", keyed_words(spark, sf_dir).withColumn("weak", weak)).select("root", "feature_key", "form")


def inflect_lookup(spark, sf_dir):
    ask = keyed_words(spark, sf_dir).select("p_partkey", "root", F.create_map(F.lit("number"), F.when(F.col("p_partkey") % 4 == 0, "pl").otherwise("sg"), F.lit("case"), F.lit("gen")).alias("features"))
    return paradigm.inflect(keyed_relation(spark, sf_dir), paradigm.checked(demo_grammar(), "noun", ask)).select("p_partkey", "root", "feature_key", "form")


def inflect_stages(spark, sf_dir):
    own = words(spark, sf_dir)
    ask = own.select("root").distinct().withColumn("feature_key", F.lit(feature_key({"number": "pl", "case": "nom"})))
    out = paradigm.stages(demo_grammar(), "noun", ask, own)
    return out.select("root", "stage_no", "stage", F.element_at("surface_forms", 1).alias("form"), "marker_kind", "marker_value")


def parse_exact(spark, sf_dir):
    own = keyed_words(spark, sf_dir)
    forms = own.select("p_partkey", F.concat("root", F.when(F.col("p_partkey") % 2 == 0, "-s").otherwise("-n")).alias("form"))
    return paradigm.parse(keyed_relation(spark, sf_dir), forms, own).select("p_partkey", "form", "root", "feature_key", "gloss")


def parse_ambiguous(spark, sf_dir):
    known = stored(keyed_relation(spark, sf_dir), "relation")
    return paradigm.parse(known, known.select("form").distinct()).groupBy("form").agg(F.count("*").alias("n_parses"), F.countDistinct("root").alias("n_roots"))


def _misspelled(spark, sf_dir):
    g = demo_grammar()
    short = roots(spark, sf_dir).select(F.concat(F.expr("substring(root, 1, 2)"), F.expr("substring(root, 4)"), F.lit("-s")).alias("query")).distinct()
    return short.withColumn("query_code", encoded(g.symbols, F.col("query")))


def search_topk(spark, sf_dir):
    return paradigm.search(relation(spark, sf_dir), _misspelled(spark, sf_dir), 5)


def search_parse(spark, sf_dir):
    own = words(spark, sf_dir)
    first = own.groupBy("root").agg(F.min_by("gloss", "p_partkey").alias("gloss"))
    return paradigm.search_parse(stored(relation(spark, sf_dir), "relation"), _misspelled(spark, sf_dir), first, 5).select("query", "form", "distance", "rank", "root", "feature_key", "gloss")


def data_grammar(spark, sf_dir) -> Grammar:
    """A grammar whose records come from the tables: a part of speech and a paradigm for each type of part, features and markers from what orders are, and classes of letters from names."""
    orders = table(spark, sf_dir, "orders")
    values = {f: sorted(r[0] for r in orders.select(c).distinct().collect()) for f, c in (("priority", "o_orderpriority"), ("status", "o_orderstatus"))}  # a handful of kinds
    part = table(spark, sf_dir, "part")
    types = sorted(r[0] for r in part.select("p_type").distinct().collect())
    signs = part.select(F.explode(F.split("p_name", " ")).alias("w")).distinct().select(F.substring("w", 1, 1).alias("ref"), F.explode(F.split("w", "")).alias("c"))
    letters = sorted((r["ref"], sorted(r["c"])) for r in signs.groupBy("ref").agg(F.collect_set("c").alias("c")).collect())
    files = {
        "Inventory": {"letters": {"kind": "Inventory", "data": [{"ref": f"<{r}>", "phones": c} for r, c in letters]}},
        "PartOfSpeech": {t: {"kind": "PartOfSpeech", "name": t, "features": list(values), "lexical_features": ["p_brand"], "principal_parts": []} for t in types},
        "FeatureDefinitions": {"orders": {"kind": "FeatureDefinitions", "features": values}},
        "FeatureMarkers": {f: {"kind": "FeatureMarkers", "feature": f, "markers": {v: [] for v in own}} for f, own in values.items()},
        "Paradigm": {t: {"kind": "Paradigm", "part_of_speech": f"${t}", "feature_markers": {f: f"${f}" for f in values}} for t in types},
    }
    return Grammar("", files)


def grammar_stats(spark, sf_dir):
    return reports.grammar_stats(spark, data_grammar(spark, sf_dir))


def inflection_meta(spark, sf_dir):
    g = data_grammar(spark, sf_dir)
    values = g.features_table(spark)
    meta = reports.inflection_meta(spark, g).select("name", F.explode("free_features").alias("feature"))
    return meta.join(values, "feature").select("name", "feature", "value", "ord")


def dup_first_wins(spark, sf_dir):
    """A second rule, pattern and class of a name that is taken count for nothing."""
    files = demo_grammar().files
    files["Rules"]["second"] = {"kind": "Rules", "rules": [{"name": "widen", "input_pattern": "o", "output_pattern": "i"}]}
    files["Inventory"]["second"] = {"kind": "Inventory", "data": [{"ref": "<C>", "phones": ["o"]}]}
    return _ruled("widen", Grammar("", files))(spark, sf_dir)


def _transitions(spark, sf_dir):
    from pyspark.sql import Window

    events = table(spark, sf_dir, "events")
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.select(F.col("event_type").alias("src"), after.alias("dst")).where("dst is not null").groupBy("src", "dst").agg(F.count("*").cast("double").alias("p"))


def edit_cost_matrix(spark, sf_dir):
    rows = _transitions(spark, sf_dir)
    names = {"": 0, "click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}
    at = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    cells = rows.select(F.element_at(at, F.col("src")).alias("i"), F.element_at(at, F.col("dst")).alias("j"), "src", "dst", F.round(1 / F.col("p"), 9).alias("cost"))
    ends = rows.groupBy("src").agg(F.sum("p").alias("p")).select(F.lit(0).alias("i"), F.element_at(at, F.col("src")).alias("j"), F.lit("").alias("src"), F.col("src").alias("dst"), F.round(1 / F.col("p"), 9).alias("cost"))
    return edit.edit_costs(cells.unionByName(ends))


def kl_uniform(spark, sf_dir):
    return edit.kl_from_uniform(_transitions(spark, sf_dir)).select("src", F.round("kl", 6).alias("kl"))


def conditional_kl(spark, sf_dir):
    rows = _transitions(spark, sf_dir)
    prior = rows.groupBy("src").agg(F.sum("p").alias("m")).crossJoin(rows.agg(F.sum("p").alias("t"))).select("src", (F.col("m") / F.col("t")).alias("prior"))
    return edit.conditional_kl(rows, prior).select(F.round("kl", 6).alias("kl"))


def _ascii_words(spark, sf_dir, column):
    return table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias(column)).distinct()


def trie_csr(spark, sf_dir):
    return edit.trie_csr(_ascii_words(spark, sf_dir, "word"))


def beam_exact(spark, sf_dir):
    own = table(spark, sf_dir, "part")
    return edit.beam_search(own.select(F.col("p_name").alias("query")), own.select(F.col("p_name").alias("word")), num_beam=5)


def beam_fuzzy(spark, sf_dir):
    """Beams wide enough to be exact: every pair of words of the names."""
    return edit.beam_search(_ascii_words(spark, sf_dir, "query"), _ascii_words(spark, sf_dir, "word"), num_beam=3000, fuzzy=True)


def weighted_edits(spark, sf_dir):
    """Pairs that share a piece, as search finds them, and their distance."""
    own = _ascii_words(spark, sf_dir, "form")
    near = paradigm.search(own.withColumn("form_code", F.col("form")), own.select(F.col("form").alias("query"), F.col("form").alias("query_code")), n=1 << 30, bound=4)
    pairs = near.select(F.col("query").alias("a"), F.col("form").alias("b"))
    return pairs.select("a", "b", edit.weighted_distance(F.col("a"), F.col("b"), bound=4.0).alias("distance")).where("distance is not null")


def _document_words(spark, sf_dir):
    """word, n of all runs of plain letters in the documents, capitals lower-cased."""
    found = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return table(spark, sf_dir, "documents").select(F.explode(found).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def search_words(spark, sf_dir):
    """Each word that the documents have once only, as a misspelling: the three nearest of the words that they have more often, within two edits."""
    own = _document_words(spark, sf_dir).withColumn("code", encoded(word_grammar().symbols, F.col("word")))
    own = stored(own, "words")
    forms = own.where("n > 1").select(F.col("word").alias("form"), F.col("code").alias("form_code"))
    return paradigm.search(forms, own.where("n = 1").select(F.col("word").alias("query"), F.col("code").alias("query_code")), 3, 2)


SYLLABLES = "(<C><V>|<C><V><C>)+"


def automaton_words(spark, sf_dir):
    """The documents' words that are open and closed syllables in a row, by an automaton: however many ways there are to divide one."""
    g = demo_grammar()
    match = automata.Automaton.of(g.patterns.parse(SYLLABLES)).accepts(encoded(g.symbols, F.col("word")))
    return _document_words(spark, sf_dir).where(match)


def automaton_difference(spark, sf_dir):
    """The documents' words that aren't, by the difference of their trie and the pattern's automaton."""
    g = demo_grammar()
    own = stored(_document_words(spark, sf_dir).select(encoded(g.symbols, F.col("word")).alias("word")), "words")
    _, ends = automata.product(automata.trie(own), automata.Automaton.of(g.patterns.parse(SYLLABLES)).tables(spark), minus=True)
    return ends.select(decoded(g.symbols, F.col("l")).alias("word"))


def pattern_beam(spark, sf_dir):
    """Words of the documents that patterns with stars accept, by beams over two automata, wide enough for all."""
    g = demo_grammar()
    own = stored(_document_words(spark, sf_dir).select(encoded(g.symbols, F.col("word")).alias("word")), "words")
    sides = []
    for q, pattern in (("doubled", "<Phone>*(<V><V>)+<Phone>*s"), ("alternating", "(<V><C>)*<V>?")):
        sides.append(edit.final_arcs(*automata.Automaton.of(g.patterns.parse(pattern)).tables(spark), "l").withColumn("q", F.lit(q)))
    right = edit.final_arcs(*automata.trie(own), "r").withColumn("step", F.length("rs") + 1)
    found = edit.beam_automata(sides[0].unionByName(sides[1]), right, num_beam=None)
    return found.select("q", decoded(g.symbols, F.col("labels")).alias("word"), "weight")


def shortest_words(spark, sf_dir):
    """The ten shortest words of each language's documents, as shortest strings of one trie for each."""
    found = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    own = table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("und")).alias("a"), F.explode(found).alias("w")).distinct()
    at = own.select("a", "w", F.explode(F.sequence(F.lit(1), F.length("w"))).alias("k"))
    arcs = at.select("a", F.expr("substring(w, 1, k - 1)").alias("state"), F.expr("substring(w, k, 1)").alias("label"), F.expr("substring(w, 1, k)").alias("next")).distinct()
    return automata.n_shortest(stored(arcs, "arcs"), own.select("a", F.col("w").alias("state")), 10).select(F.col("a").alias("lang"), F.col("string").alias("word"), "rank")


def minimal_automaton(spark, sf_dir):
    """The least automaton of all words of the documents: its states with the number of prefixes that lead there and of arcs that leave them."""
    arcs, ends, members = automata.minimal(_document_words(spark, sf_dir))
    states = members.groupBy("state").agg(F.count("*").alias("n_prefixes"))
    out = arcs.groupBy("state").agg(F.count("*").alias("n_arcs"))
    rows = states.join(out, "state", "left").join(ends.withColumn("final", F.lit(True)), "state", "left")
    return rows.select("state", "n_prefixes", F.coalesce("n_arcs", F.lit(0)).alias("n_arcs"), F.coalesce("final", F.lit(False)).alias("final"))


def _price(p):
    """An edit's cost in thousandths, from its probability."""
    return F.round(-1000 * F.log(p))


def session_search(spark, sf_dir):
    """Days of users as sequences of events: the five nearest others of each, where edits cost by how rarely events follow one another; costs by `edit_costs`."""
    rows = stored(_transitions(spark, sf_dir), "transitions")
    names = F.create_map(*(F.lit(x) for pair in {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}.items() for x in pair))
    total = rows.groupBy("src").agg(F.sum("p").alias("m"))
    cells = rows.join(total, "src").select(names[F.col("src")].alias("i"), names[F.col("dst")].alias("j"), F.substring("src", 1, 1).alias("src"), F.substring("dst", 1, 1).alias("dst"), _price(F.col("p") / F.col("m")).alias("cost"))
    whole = total.agg(F.sum("m").alias("t"))
    adding = total.join(F.broadcast(whole)).select(F.lit(0).alias("i"), names[F.col("src")].alias("j"), F.lit("").alias("src"), F.substring("src", 1, 1).alias("dst"), _price(F.col("m") / F.col("t")).alias("cost"))
    costs = [(r["src"], r["dst"], r["cost"]) for r in edit.edit_costs(cells.unionByName(adding)).collect()]  # one for each pair of kinds of events
    days = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", F.substring("event_type", 1, 1).alias("c")))), lambda x: x["c"]), "").alias("days"))
    own = stored(days.select(F.col("days").alias("form")).distinct(), "days")
    found = paradigm.search(own.select("form", F.col("form").alias("form_code")), own.select(F.col("form").alias("query"), F.col("form").alias("query_code")), 5, 3000, costs=costs, delete=1000, substitute=1000)
    return found.select("query", "form", F.col("distance").cast("long").alias("cost"), "rank")


def symbol_round_trip(spark, sf_dir):
    g = demo_grammar()
    code = encoded(g.symbols, F.translate("p_name", " ", "_"))
    return table(spark, sf_dir, "part").select("p_partkey", F.length(code).alias("n_symbols"), decoded(g.symbols, code).alias("form"))


def feature_keys(spark, sf_dir):
    bundle = F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority")
    return table(spark, sf_dir, "orders").select(feature_key_column(bundle).alias("feature_key")).groupBy("feature_key").agg(F.count("*").alias("n"))


ENDINGS = ["ing", "ed", "er", "es"]


def word_grammar() -> Grammar:
    """Words of plain letters, bare or with one of some endings."""
    markers = {"bare": None} | {e: [{"kind": "suffix", "value": e}] for e in ENDINGS}
    files = {
        "Inventory": {"letters": {"kind": "Inventory", "data": [{"ref": "<L>", "phones": list(LETTERS)}]}},
        "PartOfSpeech": {"word": {"kind": "PartOfSpeech", "name": "word", "features": ["ending"], "lexical_features": [], "principal_parts": []}},
        "FeatureDefinitions": {"word": {"kind": "FeatureDefinitions", "features": {"ending": list(markers)}}},
        "FeatureMarkers": {"ending": {"kind": "FeatureMarkers", "feature": "ending", "markers": markers}},
        "Paradigm": {"word": {"kind": "Paradigm", "part_of_speech": "$word", "feature_markers": {"ending": "$ending"}}},
    }
    return Grammar("", files)


def doc_token_parse(spark, sf_dir):
    """All documents' words of plain letters, parsed by a paradigm over the same words as roots."""
    tokens = table(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", r"[ \n]+")).alias("form")).where(F.regexp_like("form", F.lit("^[a-z]{2,}$"))).groupBy("lang", "form").agg(F.count("*").alias("n"))
    tokens = stored(tokens, "tokens")
    lexicon = tokens.select(F.col("form").alias("root")).distinct()
    found = paradigm.parse(paradigm.inflected(spark, word_grammar(), "word", lexicon), tokens)
    return found.groupBy("lang", "feature_key").agg(F.sum("n").alias("n_tokens"), F.countDistinct("root").alias("n_roots"))


QUERIES = {
    "lexicon_roots": lexicon_roots,
    "gloss_roots": gloss_roots,
    "lexical_feature_filter": lexical_feature_filter,
    "first_row_lookup": first_row_lookup,
    "principal_part_fallback": principal_part_fallback,
    "paradigm_roots": paradigm_roots,
    "pattern_filter": pattern_filter,
    "pattern_test": pattern_test,
    "rewrite_simple": _ruled("widen"),
    "rewrite_string_map": _ruled("swap"),
    "rewrite_deletion": _ruled("drop"),
    "rewrite_insertion": _ruled("insert"),
    "rule_sequence": _ruled("chain"),
    "rewrite_many": rewrite_many,
    "rule_test": rule_test,
    "feature_combos": feature_combos,
    "marker_resolution": marker_resolution,
    "unexpressed_features": unexpressed_features,
    "stage_order": stage_order,
    "inflect_table": inflect_table,
    "inflect_verbs": inflect_verbs,
    "inflect_mixed": inflect_mixed,
    "inflect_lookup": inflect_lookup,
    "inflect_stages": inflect_stages,
    "parse_exact": parse_exact,
    "parse_ambiguous": parse_ambiguous,
    "search_topk": search_topk,
    "search_parse": search_parse,
    "search_words": search_words,
    "session_search": session_search,
    "automaton_words": automaton_words,
    "automaton_difference": automaton_difference,
    "pattern_beam": pattern_beam,
    "shortest_words": shortest_words,
    "minimal_automaton": minimal_automaton,
    "grammar_stats": grammar_stats,
    "inflection_meta": inflection_meta,
    "dup_first_wins": dup_first_wins,
    "edit_cost_matrix": edit_cost_matrix,
    "kl_uniform": kl_uniform,
    "conditional_kl": conditional_kl,
    "trie_csr": trie_csr,
    "beam_exact": beam_exact,
    "beam_fuzzy": beam_fuzzy,
    "weighted_edits": weighted_edits,
    "symbol_round_trip": symbol_round_trip,
    "feature_keys": feature_keys,
    "doc_token_parse": doc_token_parse,
}

WIDENED = "regexp_replace(root, '([b-df-hj-np-tv-z])o', '\\1au', 'g')"
KEYED = f"translate(p_partkey::VARCHAR, '{KEY[0]}', '{KEY[1]}') || '_' || replace(p_name, ' ', '_')"
KEYED_SQL = f"SELECT {KEYED} AS root FROM part"


def _forms_sql(roots_sql: str) -> str:
    return f"""
SELECT root, '[case=nom][number=sg]' AS feature_key, root AS form FROM ({roots_sql})
UNION ALL SELECT root, '[case=gen][number=sg]', root || '-n' FROM ({roots_sql})
UNION ALL SELECT root, '[case=nom][number=pl]', {WIDENED} || '-s' FROM ({roots_sql})
UNION ALL SELECT root, '[case=gen][number=pl]', root || '-n' FROM ({roots_sql})"""


FORMS_SQL, KEYED_FORMS_SQL = _forms_sql(ROOTS_SQL), _forms_sql(KEYED_SQL)
GLOSS_SQL = "SELECT replace(p_name, ' ', '_') AS root, arg_min(p_brand, p_partkey) AS gloss FROM part GROUP BY 1"
SEARCH_SQL = f"""
WITH f AS ({FORMS_SQL}), d AS (SELECT DISTINCT form FROM f),
q AS (SELECT DISTINCT substr(root, 1, 2) || substr(root, 4) || '-s' AS query FROM ({ROOTS_SQL})),
m AS (SELECT query, form, levenshtein(query, form) AS distance FROM q, d WHERE levenshtein(query, form) <= 5),
r AS (SELECT query, form, distance::DOUBLE AS distance, row_number() OVER (PARTITION BY query ORDER BY distance, form)::INT AS rank FROM m)
"""
TRANSITIONS_SQL = """
e AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events),
t AS (SELECT src, dst, count(*)::DOUBLE AS p FROM e WHERE dst IS NOT NULL GROUP BY ALL)"""
KL_SQL = f"WITH {TRANSITIONS_SQL}, s AS (SELECT src, p / sum(p) OVER (PARTITION BY src) AS p, count(*) OVER (PARTITION BY src) AS n FROM t), k AS (SELECT src, sum(p * ln(p * n)) AS kl FROM s GROUP BY src)"


def _rewrite_sql(expression: str) -> str:
    return f"SELECT root, {expression} AS form FROM ({ROOTS_SQL})"


WORDS_SQL = "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) GROUP BY word"
SYLLABLES_SQL = "regexp_full_match(word, '([^aeiou][aeiou]|[^aeiou][aeiou][^aeiou])+')"

ORACLES = {
    "automaton_words": f"SELECT word, n FROM ({WORDS_SQL}) WHERE {SYLLABLES_SQL}",
    "automaton_difference": f"SELECT word FROM ({WORDS_SQL}) WHERE NOT {SYLLABLES_SQL}",
    "pattern_beam": f"""
        SELECT 'doubled' AS q, word, 0.0::DOUBLE AS weight FROM ({WORDS_SQL}) WHERE regexp_full_match(word, '.*[aeiou][aeiou].*s')
        UNION ALL SELECT 'alternating', word, 0.0 FROM ({WORDS_SQL}) WHERE regexp_full_match(word, '([aeiou][^aeiou])*[aeiou]?')""",
    "shortest_words": """
        WITH w AS (SELECT DISTINCT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)
        SELECT lang, word, rank FROM (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY length(word), word)::INT AS rank FROM w) WHERE rank <= 10""",
    "minimal_automaton": f"""
        WITH p AS (SELECT substr(word, 1, k) AS prefix, substr(word, k + 1) AS rest FROM ({WORDS_SQL}), range(0, 60) t(k) WHERE k <= length(word)),
        f AS (SELECT prefix, string_agg(rest, '|' ORDER BY rest) AS follow, bool_or(rest = '') AS final, count(DISTINCT substr(rest, 1, 1)) FILTER (WHERE rest <> '') AS n_arcs FROM p GROUP BY prefix)
        SELECT min(prefix) AS state, count(*) AS n_prefixes, any_value(n_arcs) AS n_arcs, any_value(final) AS final FROM f GROUP BY follow""",
    "lexicon_roots": f"SELECT root, count(*) AS n FROM (SELECT replace(p_name, ' ', '_') AS root FROM part UNION ALL {KEYED_SQL}) GROUP BY root",
    "gloss_roots": "SELECT replace(p_name, ' ', '_') AS root, count(*) AS n FROM part WHERE p_brand = 'Brand#7' GROUP BY 1",
    "lexical_feature_filter": "SELECT p_partkey, p_name FROM part WHERE p_type = 'PROMO' AND p_brand = 'Brand#3'",
    "first_row_lookup": "SELECT replace(p_name, ' ', '_') AS root, p_brand AS gloss, p_type FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1",
    "principal_part_fallback": """
        WITH x AS (SELECT replace(p_name, ' ', '_') AS root, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN lower(p_brand) END AS pp FROM part)
        SELECT root, coalesce(nullif(pp, ''), root) AS stem, count(*) AS n FROM x GROUP BY ALL""",
    "paradigm_roots": "SELECT replace(p_name, ' ', '_') AS root, count(*) AS n FROM part WHERE p_type = 'SMALL' AND regexp_full_match(p_name, '[^aeiou ]+[aeiou][^aeiou ] .*') GROUP BY 1",
    "pattern_filter": f"SELECT root FROM ({ROOTS_SQL}) WHERE regexp_full_match(root, '([^aeiou_]?[^aeiou_]|[^aeiou_][a-z])[aeiou]+[^aeiou_]*_[bgrw].*')",
    "pattern_test": f"""
        WITH c AS (SELECT '<Short>' AS ref, regexp_full_match(root, '[^aeiou_][aeiou][^aeiou_]_.*') = (substr(root, 4, 1) = '_') AS pass FROM ({ROOTS_SQL})
          UNION ALL SELECT '<Open>', NOT regexp_full_match(root, '.*[aeiou]') FROM ({ROOTS_SQL}))
        SELECT ref, bool_and(pass) AS all_pass, count(*) FILTER (WHERE pass) AS n_pass, count(*) AS n FROM c GROUP BY ref""",
    "rewrite_simple": _rewrite_sql(WIDENED),
    "rewrite_string_map": _rewrite_sql("translate(regexp_replace(regexp_replace(regexp_replace(root, 'a([b-df-hj-np-tv-z])', '1\\1', 'g'), 'e([b-df-hj-np-tv-z])', '2\\1', 'g'), 'i([b-df-hj-np-tv-z])', '3\\1', 'g'), '123', 'eao')"),
    "rewrite_deletion": _rewrite_sql("replace(replace(root, 'll', 'l'), 'ld', 'd')"),
    "rewrite_insertion": _rewrite_sql("regexp_replace(root, 't$', 'te')"),
    "rule_sequence": _rewrite_sql("regexp_replace(replace(replace(root, 'll', 'l'), 'ld', 'd'), '([b-df-hj-np-tv-z])o', '\\1au', 'g')"),
    "rewrite_many": f"""
        WITH r AS (SELECT root, regexp_replace(regexp_replace(root, 'g([aeiou])', '1\\1'), 'g([aeiou])', '2\\1') AS x FROM ({ROOTS_SQL}))
        SELECT DISTINCT root, replace(replace(x, '1', a), '2', b) AS form FROM r, unnest(['g', 'k']) t(a), unnest(['g', 'k']) u(b)""",
    "rule_test": f"""
        WITH c AS (SELECT root, replace(root, 'rod', 'raud') AS expected, {WIDENED} AS output FROM ({ROOTS_SQL}))
        SELECT root AS input, expected, output, expected = output AS pass FROM c""",
    "feature_combos": """
        SELECT priority, status FROM (SELECT DISTINCT o_orderpriority AS priority FROM orders UNION ALL SELECT 'unmarked') a,
          (SELECT DISTINCT o_orderstatus AS status FROM orders UNION ALL SELECT 'unmarked') b""",
    "marker_resolution": """
        WITH c AS (SELECT DISTINCT o_orderpriority || '/' || o_orderstatus AS cell, o_orderpriority AS p, o_orderstatus AS s FROM orders),
        h AS (SELECT cell, 'c1' AS file, 'priority+status' AS feature, v.pos, v.marker FROM c, (VALUES ('F', 0, 'uf'), ('x', 0, 'u'), ('x', 1, 'u2')) v(k, pos, marker)
            WHERE p = '1-URGENT' AND (s = 'F') = (v.k = 'F')
          UNION ALL SELECT cell, 'c2', 'status', 0, 'p' FROM c WHERE s = 'P')
        SELECT * FROM h
        UNION ALL SELECT cell, 'r1', 'priority', 0, substr(p, 1, 1) FROM c WHERE p IN ('2-HIGH', '3-MEDIUM', '5-LOW')
        UNION ALL SELECT cell, 'r2', 'status', 0, lower(s) FROM c WHERE p <> '1-URGENT' AND s <> 'P'""",
    "unexpressed_features": "SELECT DISTINCT o_orderpriority || '/' || o_orderstatus AS cell, 'priority' AS feature FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED'",
    "stage_order": "SELECT o_orderkey, substr(o_orderpriority, 3) AS stage, CASE substr(o_orderpriority, 3) WHEN 'HIGH' THEN 1 WHEN 'URGENT' THEN 2 WHEN 'LOW' THEN 3 ELSE 2147483647 END::BIGINT AS stage_rank FROM orders",
    "inflect_table": f"SELECT 'noun' AS paradigm, root, feature_key, form, form AS form_tagged FROM ({KEYED_FORMS_SQL})",
    "inflect_verbs": f"""
        WITH p AS (SELECT {KEYED} AS root, p_partkey FROM part WHERE p_type = 'PROMO'),
        x AS (SELECT root, person, tense, CASE person WHEN 'one' THEN root WHEN 'three' THEN 'zu' ELSE root || CASE WHEN p_partkey % 3 <> 0 THEN '[hard]e' ELSE '' END END AS s
          FROM p, (VALUES ('one'), ('two'), ('three')) a(person), (VALUES ('pres'), ('past'), ('perf')) b(tense)),
        y AS (SELECT root, '[person=' || person || '][tense=' || tense || '][voice=active]' AS feature_key,
          CASE tense WHEN 'past' THEN 'ge_' || s WHEN 'perf' THEN replace(s, '_', '') ELSE s END || CASE person WHEN 'one' THEN '-m' WHEN 'two' THEN '-t' ELSE '' END || 'q' AS form_tagged FROM x)
        SELECT root, feature_key, replace(form_tagged, '[hard]', '') AS form, form_tagged FROM y""",
    "inflect_mixed": f"""
        WITH p AS (SELECT {KEYED} AS root, {KEYED} || CASE WHEN p_partkey % 3 <> 0 THEN 'e' ELSE '' END AS stem FROM part)
        SELECT root, '[case=' || c || '][number=' || n || ']' AS feature_key, CASE n || c WHEN 'sgnom' THEN root WHEN 'sggen' THEN 'ge_' || root WHEN 'sgdat' THEN root || '-m'
          WHEN 'plnom' THEN stem || '-s' WHEN 'plgen' THEN replace(root, '_', 'a') || '-x' ELSE stem || '-s-m' END || 'q' AS form
        FROM p, (VALUES ('sg'), ('pl')) a(n), (VALUES ('nom'), ('gen'), ('dat')) b(c)""",
    "inflect_lookup": f"""
        WITH f AS ({KEYED_FORMS_SQL}), a AS (SELECT p_partkey, {KEYED} AS root, '[case=gen][number=' || CASE WHEN p_partkey % 4 = 0 THEN 'pl' ELSE 'sg' END || ']' AS feature_key FROM part)
        SELECT p_partkey, root, feature_key, form FROM a JOIN f USING (root, feature_key)""",
    "inflect_stages": f"""
        WITH r AS (SELECT root, {WIDENED} AS up FROM ({ROOTS_SQL}))
        SELECT root, 0 AS stage_no, 'Initial' AS stage, root AS form, '' AS marker_kind, '' AS marker_value FROM r
        UNION ALL SELECT root, 1, 'vowels', up, 'rule', '$widen' FROM r
        UNION ALL SELECT root, 2, 'suffix', up || '-s', 'suffix', '-s' FROM r
        UNION ALL SELECT root, 3, 'Final', up || '-s', '', '' FROM r""",
    "parse_exact": f"""
        WITH f AS ({KEYED_FORMS_SQL}), a AS (SELECT p_partkey, {KEYED} || CASE WHEN p_partkey % 2 = 0 THEN '-s' ELSE '-n' END AS form FROM part)
        SELECT p_partkey, form, root, feature_key, gloss FROM a JOIN f USING (form) LEFT JOIN (SELECT {KEYED} AS root, p_brand AS gloss FROM part) USING (root)""",
    "parse_ambiguous": f"SELECT form, count(*) AS n_parses, count(DISTINCT root) AS n_roots FROM ({KEYED_FORMS_SQL}) GROUP BY form",
    "search_topk": f"{SEARCH_SQL} SELECT query, form, distance, rank FROM r WHERE rank <= 5",
    "search_parse": f"{SEARCH_SQL} SELECT query, form, distance, rank, root, feature_key, gloss FROM r JOIN f USING (form) LEFT JOIN ({GLOSS_SQL}) USING (root) WHERE rank <= 5",
    "search_words": """
        WITH t AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) GROUP BY word),
        v AS (SELECT word, n, word AS v FROM t
          UNION ALL SELECT word, n, substr(word, 1, i - 1) || substr(word, i + 1) FROM t, range(1, 60) a(i) WHERE i <= length(word)
          UNION ALL SELECT word, n, substr(word, 1, i - 1) || substr(word, i + 1, j - i - 1) || substr(word, j + 1) FROM t, range(1, 60) a(i), range(1, 60) b(j) WHERE i < j AND j <= length(word)),
        p AS (SELECT DISTINCT q.word AS query, f.word AS form FROM v q JOIN v f USING (v) WHERE q.n = 1 AND f.n > 1),
        d AS (SELECT query, form, levenshtein(query, form) AS distance FROM p)
        SELECT query, form, distance::DOUBLE AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, form)::INT AS rank FROM d WHERE distance <= 2) WHERE rank <= 3""",
    "session_search": f"""
        WITH {TRANSITIONS_SQL},
        m AS (SELECT src, sum(p) AS m FROM t GROUP BY src),
        k AS (SELECT substr(t.src, 1, 1) || substr(t.dst, 1, 1) AS k, round(-1000 * ln(p / m)) AS c FROM t JOIN m ON t.src = m.src WHERE t.src <> t.dst
          UNION ALL SELECT '>' || substr(src, 1, 1), round(-1000 * ln(m / (SELECT sum(m) FROM m))) FROM m),
        c AS (SELECT map(list(k), list(c)) AS c FROM k),
        w AS (SELECT DISTINCT string_agg(substr(event_type, 1, 1), '' ORDER BY ts, event_id) OVER (PARTITION BY user_id, ts::DATE ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS s FROM events),
        x AS (SELECT s, string_split(s, '') AS l FROM w),
        d AS (SELECT a.s AS query, b.s AS form, list_reduce(list_transform(a.l, lambda e: [ascii(e)::DOUBLE]),
            lambda row, e: list_reduce(list_prepend([row[1] + 1000], list_transform(range(1, len(b.l) + 1), lambda j: [j::DOUBLE])),
              lambda acc, j: list_append(acc, least(row[j[1]::INT] + CASE WHEN chr(e[1]::INT) = b.l[j[1]::INT] THEN 0 ELSE coalesce(c[chr(e[1]::INT) || b.l[j[1]::INT]], 1000) END, row[j[1]::INT + 1] + 1000, acc[-1] + coalesce(c['>' || b.l[j[1]::INT]], 1000)))),
            list_reduce(list_prepend([0.0::DOUBLE], list_transform(b.l, lambda y: [coalesce(c['>' || y], 1000)])), lambda acc, y: list_append(acc, acc[-1] + y[1]))) AS r FROM x a, x b, c)
        SELECT query, form, cost, rank FROM (SELECT query, form, r[-1]::BIGINT AS cost, row_number() OVER (PARTITION BY query ORDER BY r[-1], form)::INT AS rank FROM d WHERE r[-1] <= 3000) WHERE rank <= 5""",
    "grammar_stats": """
        WITH v AS (SELECT count(DISTINCT o_orderpriority) + count(DISTINCT o_orderstatus) AS n FROM orders), t AS (SELECT count(DISTINCT p_type) AS n FROM part),
        c AS (SELECT count(DISTINCT substr(w, 1, 1)) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part))
        SELECT kind, files::BIGINT AS files, 0::BIGINT AS invalid_files, total::BIGINT AS total FROM (
          SELECT 'Inventory' AS kind, 1 AS files, n AS total FROM c UNION ALL SELECT 'PartOfSpeech', n, 2 * n FROM t UNION ALL SELECT 'FeatureDefinitions', 1, 2
          UNION ALL SELECT 'FeatureMarkers', 2, n FROM v UNION ALL SELECT 'Paradigm', n, 2 * n FROM t)""",
    "inflection_meta": """
        WITH v AS (SELECT 'priority' AS feature, o_orderpriority AS value, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS ord FROM (SELECT DISTINCT o_orderpriority FROM orders)
          UNION ALL SELECT 'status', o_orderstatus, dense_rank() OVER (ORDER BY o_orderstatus) - 1 FROM (SELECT DISTINCT o_orderstatus FROM orders)),
        u AS (SELECT * FROM v UNION ALL SELECT feature, 'unmarked', count(*) FROM v GROUP BY feature)
        SELECT name, feature, value, ord::INT AS ord FROM (SELECT DISTINCT p_type AS name FROM part), u""",
    "dup_first_wins": _rewrite_sql(WIDENED),
    "edit_cost_matrix": f"""
        WITH {TRANSITIONS_SQL}
        SELECT src, dst, round(1 / p, 9) AS cost, 'substitute' AS op FROM t WHERE src <> dst
        UNION ALL SELECT '', src, round(1 / sum(p), 9), 'insert' FROM t GROUP BY src""",
    "kl_uniform": f"{KL_SQL} SELECT src, round(kl, 6) AS kl FROM k",
    "conditional_kl": f"{KL_SQL}, w AS (SELECT src, sum(p) / (SELECT sum(p) FROM t) AS prior FROM t GROUP BY src) SELECT round(avg(prior * kl), 6) AS kl FROM k JOIN w USING (src)",
    "trie_csr": """
        WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part),
        p AS (SELECT DISTINCT substr(word, 1, n) AS prefix FROM w, range(0, 60) t(n) WHERE n <= length(word)),
        a AS (SELECT p.prefix, count(c.prefix) AS n_arcs, bool_or(w.word IS NOT NULL) AS final FROM p
          LEFT JOIN p c ON length(c.prefix) = length(p.prefix) + 1 AND starts_with(c.prefix, p.prefix) LEFT JOIN w ON w.word = p.prefix GROUP BY p.prefix)
        SELECT prefix, n_arcs, (coalesce(sum(n_arcs) OVER (ORDER BY prefix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset", final FROM a""",
    "beam_exact": "SELECT DISTINCT p_name AS q, p_name AS labels, 0.0::DOUBLE AS weight FROM part",
    "beam_fuzzy": """
        WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS x FROM part)
        SELECT a.x AS q, b.x AS labels, levenshtein(a.x, b.x)::DOUBLE AS weight FROM w a, w b""",
    "weighted_edits": """
        WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS x FROM part)
        SELECT a.x AS a, b.x AS b, levenshtein(a.x, b.x)::DOUBLE AS distance FROM w a, w b WHERE levenshtein(a.x, b.x) <= 4""",
    "symbol_round_trip": "SELECT p_partkey, length(p_name)::INT AS n_symbols, replace(p_name, ' ', '_') AS form FROM part",
    "feature_keys": "SELECT '[priority=' || o_orderpriority || '][status=' || o_orderstatus || ']' AS feature_key, count(*) AS n FROM orders GROUP BY 1",
    "doc_token_parse": f"""
        WITH t AS (SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest(regexp_split_to_array(text, '[ \\n]+')) AS token FROM documents) WHERE regexp_full_match(token, '[a-z]{{2,}}') GROUP BY ALL),
        r AS (SELECT DISTINCT token AS root FROM t),
        f AS (SELECT root, '[ending=bare]' AS feature_key, root AS form FROM r UNION ALL SELECT root, '[ending=' || e || ']', root || e FROM r, (VALUES {", ".join(f"('{e}')" for e in ENDINGS)}) v(e))
        SELECT lang, feature_key, sum(n)::BIGINT AS n_tokens, count(DISTINCT root) AS n_roots FROM t JOIN f ON t.token = f.form GROUP BY ALL""",
}
