"""Run names: parse the parameters written into them, and display names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: columns a run can be built on, in order of preference ------
DATA_COLUMNS = (
    "text_raw", "text_clean", "text_expanded", "tokens_cased", "tokens_lower",
    "tokens_filtered", "tokens_letters", "tokens_stemmed", "tokens_lemmatized",
)
# --- fixed values: display names ----------------------------------------------
TOKEN_DISPLAY = {
    "tokens_cased": "Tokens Cased",
    "tokens_lower": "Tokens Lower",
    "tokens_letters": "Tokens Letters",
    "tokens_filtered": "Tokens Filtered",
    "tokens_stemmed": "Tokens Stemmed",
    "tokens_lemmatized": "Tokens Lemmatized",
}
MODEL_DISPLAY = {"linear_svm": "Linear SVM", "logreg": "Logistic Regression"}
MODEL_SHORT = {"linear_svm": "SVM", "logreg": "LR"}
CASCADE_DISPLAY = {
    "BERT_Basic_Cascade": "Base + Basic BERT",
    "BERT_Spec_Cascade": "Base + Spec. BERT",
    "SVM_Spec_Cascade": "Base + Spec. SVM",
    "BERT_Basic": "BERT Basic",
}
# defaults of parameters missing in a name
DEFAULT_NGRAM = "1-3"
DEFAULT_Z = 2.0
DEFAULT_TOKENS = "tokens_lower"


def _part(name: Column, pattern: str) -> Column:
    """First underscore-separated part that matches, without its letter; or null."""
    found = F.regexp_extract(name, r"(?:^|_)" + pattern + r"(?:_|$)", 1)
    return F.nullif(found, F.lit(""))


def parse_run_name(name: Column | str) -> dict[str, Column]:
    """Columns model, token_col, ngram, k, z, w; null where the name has none."""
    n = F.col(name) if isinstance(name, str) else name
    token = F.coalesce(*[F.when(n.contains(c), F.lit(c)) for c in DATA_COLUMNS])
    return {
        "model": F.when(F.lower(n).contains("svm"), "linear_svm").otherwise("logreg"),
        "token_col": token,
        "ngram": _part(n, r"ng(\d+-\d+)"),
        "k": _part(n, r"k(\d+)").cast("int"),
        "z": _part(n, r"[zZ](\d+(?:\.\d+)?)").cast("double"),
        "w": _part(n, r"w(\d+(?:\.\d+)?)").cast("double"),
    }


def parse_with_defaults(name: Column | str) -> dict[str, Column]:
    """As parse_run_name, with the defaults of the best-configuration report."""
    got = parse_run_name(name)
    return got | {
        "token_col": F.coalesce(got["token_col"], F.lit(DEFAULT_TOKENS)),
        "ngram": F.coalesce(got["ngram"], F.lit(DEFAULT_NGRAM)),
        "k": F.coalesce(got["k"], F.lit(0)),
        "z": F.coalesce(got["z"], F.lit(DEFAULT_Z)),
        "w": F.coalesce(got["w"], F.lit(0.0)),
    }


def representation(name: Column | str) -> Column:
    """The representation written into a run name, or null."""
    n = F.col(name) if isinstance(name, str) else name
    return F.coalesce(
        *[F.when(n.contains(f"_{r}_"), F.lit(r))
          for r in ("CustomTfidf", "CustomBow", "TF-IDF", "BoW")]
    )


def display_name(code: Column, table: dict[str, str]) -> Column:
    """Display name of a code; codes that are not listed stay as they are."""
    out = code
    for key, shown in reversed(list(table.items())):
        out = F.when(code == key, shown).otherwise(out)
    return out


def run_keys(df: DataFrame) -> list[str]:
    """The columns that tell runs apart: a model's name may occur in several experiments."""
    return [c for c in ("experiment", "model") if c in df.columns]


def cascade_name(specialist: Column | str) -> Column:
    """Name of the cascade that delegates to a specialist, e.g. SVM_Spec_Cascade."""
    s = F.col(specialist) if isinstance(specialist, str) else specialist
    return F.concat(F.regexp_replace(s, "_Specialist$", "_Spec"), F.lit("_Cascade"))


def short_model_name(model: Column) -> Column:
    for key, shown in MODEL_SHORT.items():
        model = F.replace(model, F.lit(key), F.lit(shown))
    return model
