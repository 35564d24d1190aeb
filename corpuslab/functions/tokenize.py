"""Fixed tables of the metric tokenisers, used by the Arrow pass
(``corpuslab.functions.ngram``) and by the SQL twins."""

# ---- fixed values -------------------------------------------------------
# 13a tokeniser of mteval-v13a / sacreBLEU, applied to ' ' + line + ' ':
# pre-replacements (in order), then four regex rules (in order).
T13A_PRE = [("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'),
            ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]
T13A_RULES = [
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" $1 "),
    (r"([^0-9])([\.,])", r"$1 $2 "),
    (r"([\.,])([^0-9])", r" $1 $2"),
    (r"([0-9])(-)", r"$1 $2 "),
]
# Punctuation that chrF++ splits off word edges (Python string.punctuation).
CHRF_PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# ------------------------------------------------------------------------
