"""The language registry: names, model names and words near phone numbers, and what a detector setup needs of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Code: name, words near phone numbers.
REGISTRY: dict[str, tuple[str, list[str]]] = {
    "ca": ("Catalan", ["telèfon", "número", "mòbil", "trucada", "trucar"]),
    "zh": ("Chinese", ["电话", "手机", "号码", "打电话", "电话号码", "手机号码"]),
    "hr": ("Croatian", ["telefon", "broj", "mobitel", "poziv", "nazovi", "zvati"]),
    "da": ("Danish", ["telefon", "nummer", "mobil", "mobiltelefon", "opkald", "ringe"]),
    "nl": ("Dutch", ["telefoon", "nummer", "mobiel", "mobieltje", "GSM", "bellen"]),
    "en": ("English", ["phone", "number", "telephone", "cell", "cellphone", "mobile", "call"]),
    "fi": ("Finnish", ["puhelin", "numero", "kännykkä", "matkapuhelin", "soittaa", "puhelinnumero"]),
    "fr": ("French", ["téléphone", "numéro", "portable", "mobile", "appeler", "tél"]),
    "de": ("German", ["telefon", "nummer", "handy", "mobiltelefon", "anruf", "rufnummer"]),
    "el": ("Greek", ["τηλέφωνο", "αριθμός", "κινητό", "κλήση", "τηλεφωνώ", "καλώ"]),
    "it": ("Italian", ["telefono", "numero", "cellulare", "telefonino", "chiamare", "chiamata"]),
    "ja": ("Japanese", ["電話", "携帯", "番号", "スマホ", "ケータイ", "電話番号"]),
    "ko": ("Korean", ["전화", "휴대폰", "핸드폰", "번호", "전화번호", "통화"]),
    "lt": ("Lithuanian", ["telefonas", "numeris", "mobilusis", "skambutis", "skambinti"]),
    "mk": ("Macedonian", ["телефон", "број", "мобилен", "повик", "звони"]),
    "nb": ("Norwegian", ["telefon", "nummer", "mobil", "mobiltelefon", "samtale", "ringe"]),
    "pl": ("Polish", ["telefon", "numer", "komórka", "komórkowy", "dzwoń", "zadzwoń"]),
    "pt": ("Portuguese", ["telefone", "número", "celular", "telemóvel", "ligar", "telefonar"]),
    "ro": ("Romanian", ["telefon", "număr", "mobil", "apel", "suna"]),
    "ru": ("Russian", ["телефон", "номер", "мобильник", "мобила", "сотовый", "звонок"]),
    "sl": ("Slovenian", ["telefon", "številka", "mobilnik", "mobilec", "klic", "pokliči"]),
    "es": ("Spanish", ["teléfono", "número", "móvil", "celular", "llamar", "llamada"]),
    "sv": ("Swedish", ["telefon", "nummer", "mobil", "mobiltelefon", "samtal", "ringa"]),
    "uk": ("Ukrainian", ["телефон", "номер", "мобільний", "мобілка", "дзвінок", "дзвони"]),
}

# Labels of language models, as entity types.
LABELS = {
    "PER": "PERSON", "PERSON": "PERSON", "LOC": "LOCATION", "GPE": "LOCATION", "ORG": "ORGANIZATION",
    "persName": "PERSON", "placeName": "LOCATION", "geogName": "LOCATION", "orgName": "ORGANIZATION",
    "PS": "PERSON", "LC": "LOCATION", "OG": "ORGANIZATION", "PRS": "PERSON", "GPE_LOC": "LOCATION",
}
# Fixed value: how much a label counts whose hits are unreliable.
LOW_SCORE = {"ORG": 0.4}

# Labels that a model setup leaves out.
IGNORED = ["O", "CARDINAL", "EVENT", "LANGUAGE", "LAW", "MONEY", "ORDINAL", "PERCENT", "PRODUCT", "QUANTITY", "WORK_OF_ART"]

# The recognisers that are set up.
RECOGNIZERS = ["NER", "Email", "Phone", "CreditCard", "Iban", "Ip"]


def contexts(languages: list[str]) -> dict[str, list[str]]:
    return {k: REGISTRY[k][1] for k in languages if k in REGISTRY}


def supported(configured: list[str], available: list[str] | None = None) -> dict[str, list[str]]:
    """Configured languages that are available, and those that are missing."""
    known = list(REGISTRY) if available is None else available
    return {"available": [x for x in configured if x in known], "missing": [x for x in configured if x not in known]}


def model_name(language: str) -> str:
    """The language model's name: those of English and Chinese are trained on the web, the others on news."""
    return f"{language}_core_{'web' if language in ('en', 'zh') else 'news'}_lg"


def model_setup(languages: list[str]) -> dict:
    """The language models of a detector setup, and what their labels stand for."""
    if unknown := [x for x in languages if x not in REGISTRY]:
        raise ValueError(f"unknown languages: {', '.join(unknown)}")
    return {
        "models": [{"lang_code": x, "model_name": model_name(x)} for x in languages],
        "labels": LABELS, "low_score_labels": list(LOW_SCORE), "low_score_multiplier": LOW_SCORE["ORG"], "labels_to_ignore": IGNORED,
    }


def analyzer_setup(languages: list[str]) -> dict:
    return {"supported_languages": list(languages), "default_score_threshold": 0}


def recognizer_setup(languages: list[str]) -> list[dict]:
    """One entry for each recogniser, with its languages; the phone recogniser's with their context words."""
    if unknown := [x for x in languages if x not in REGISTRY]:
        raise ValueError(f"unknown languages: {', '.join(unknown)}")
    entry = lambda r, x: {"language": x} | ({"context": REGISTRY[x][1]} if r == "Phone" else {})
    return [{"name": f"{r}Recognizer", "supported_languages": [entry(r, x) for x in languages]} for r in RECOGNIZERS]


def registry_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, n, model_name(k), w) for k, (n, w) in REGISTRY.items()], "language string, name string, model string, phone_context array<string>")
