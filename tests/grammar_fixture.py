"""A small grammar of an invented language, written to a folder as YAML and CSV: nouns that take the part they play as an ending.

Hard and soft nouns have endings of their own. Gliding nouns are hard, dulled ones soft, and change their stem in some roles; the agent is built on
the oblique stem where a word has one.
"""

import yaml

ROLES = ["agent", "patient", "place", "source", "tool", "company"]
HARD, SOFT = ["a", "un", "ist", "olo", "eká", "ur"], ["e", "in", "est", "elo", "iká", "ir"]
ENDINGS = {"hard": HARD, "soft": SOFT, "gliding": HARD, "dulled": SOFT}
CHANGED = {"agent", "patient", "tool"}
CHANGE = {"gliding": "$glide", "dulled": "$dull"}
WORDS = [("tamb", "drum", "hard", ""), ("lok", "door", "hard", ""), ("sen", "river", "soft", ""), ("mur", "wall", "gliding", ""), ("pal", "hand", "gliding", "pa[Hold]lt"), ("vit", "road", "dulled", ""), ("rat", "knot", "dulled", "rakt"), ("gosh", "lamp", "soft")]
#: root -> forms in the order of ROLES.
GOLDEN = {
    "tamb": "tamb-a tamb-un tamb-ist tamb-olo tamb-eká tamb-ur",
    "sen": "sen-e sen-in sen-est sen-elo sen-iká sen-ir",
    "gosh": "gosh-e gosh-in gosh-est gosh-elo gosh-iká gosh-ir",
    "mur": "muir-a muir-un mur-ist mur-olo muir-eká mur-ur",
    "pal": "palt-a paul-un pal-ist pal-olo paul-eká pal-ur",
    "vit": "vis-e vis-in vit-est vit-elo vis-iká vit-ir",
    "rat": "raks-e ras-in rat-est rat-elo ras-iká rat-ir",
}


def put(folder, name, data):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{name}.yaml").write_text(yaml.safe_dump(data, allow_unicode=True), encoding="utf-8")


def write(root):
    put(root / "Phonology/Inventory", "sounds", {"kind": "Inventory", "data": [
        {"name": "Consonants", "ref": "<C>", "children": [{"ref": "<Hissing>", "phones": ["s", "sh", "z"]}, {"phones": list("bdgklmnprtv")}]},
        {"name": "Vowels", "ref": "<V>", "phones": list("aeiou") + ["́"]},
        {"name": "Tags", "ref": "<Marks>", "tags": ["[Hold]"]},
    ]})
    put(root / "Phonology/Patterns", "patterns", {"kind": "Patterns", "patterns": [
        {"ref": "<Beat>", "pattern": "<Core><C>*", "test_includes": ["aul", "osh"], "test_excludes": ["g"]},
        {"ref": "<Core>", "pattern": "au|ui|<V>"},
    ]})
    put(root / "Phonology/Rules", "rules", {"kind": "Rules", "rules": [
        {"name": "glide", "string_map": [["a", "au"], ["u", "ui"]], "right_context": "<C>*#", "test_mappings": [["mur", "muir"], ["sen", "sen"]]},
        {"name": "dull", "input_pattern": "t", "output_pattern": "s", "right_context": "#"},
        {"name": "both", "rule_sequence": ["$dull", "$glide"]},
    ]})
    put(root / "Lexicon/PartOfSpeech", "noun", {"kind": "PartOfSpeech", "name": "noun", "features": ["number", "role", "style"], "lexical_features": ["sort"], "principal_parts": ["oblique"]})
    put(root / "Exponence/FeatureDefinitions", "nouns", {"kind": "FeatureDefinitions", "features": {"number": ["many", "one"], "style": ["plain"], "role": ROLES}})
    for name, ends in ENDINGS.items():
        markers = {}
        for role, end in zip(ROLES, ends, strict=True):
            own = [{"kind": "suffix", "value": f"-{end}", "stage": "ending"}]
            if name in CHANGE and role in CHANGED:
                own.append({"kind": "rule", "value": CHANGE[name], "stage": "stem", "comment": "changed"})
            if role == "agent":
                own.append({"kind": "principal_part", "value": "oblique"})
            markers[role] = own
        put(root / "Exponence/FeatureMarkers", f"{name}_roles", {"kind": "FeatureMarkers", "feature": "role", "markers": markers})
        put(root / "Morphotactics/Paradigm", f"noun_{name}", {"kind": "Paradigm", "part_of_speech": "$noun", "feature_markers": {"role": f"${name}_roles", "number": "one", "style": "plain"}, "stage_order": ["stem", "ending"], "filter": {"lexical_features": {"sort": name}}})
    put(root / "Phonology/Rules", "zbroken", {"kind": "Rules", "rules": [{"description": "no name"}]})
    words = root / "Lexicon/Wordlists"
    words.mkdir(parents=True)
    (words / "noun.csv").write_text("root,gloss,sort,oblique\n" + "".join(f"{','.join(w)}\n" for w in WORDS), encoding="utf-8")
    return root
