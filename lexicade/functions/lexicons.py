"""Small word lists used by the text functions.

All of them are defaults: every function that uses one takes a replacement.
"""

from __future__ import annotations

# --- fixed values: typography unification, one character to one character ----
TYPOGRAPHY = {
    "`": "'",
    "´": "'",
    "’": "'",
    "‘": "'",
    "“": '"',
    "”": '"',
    "„": '"',
    "–": "-",
    "—": "-",
    "−": "-",
    "\x96": "-",
    "\x97": "-",
}
# the only rule that expands one character to three
ELLIPSIS = ("…", "...")

# --- fixed values: English contractions, lower case ---------------------------
CONTRACTIONS = {
    "ain't": "are not",
    "aren't": "are not",
    "can't": "cannot",
    "could've": "could have",
    "couldn't": "could not",
    "daren't": "dare not",
    "didn't": "did not",
    "doesn't": "does not",
    "don't": "do not",
    "hadn't": "had not",
    "hasn't": "has not",
    "haven't": "have not",
    "he'd": "he would",
    "he'll": "he will",
    "he's": "he is",
    "here's": "here is",
    "how'd": "how did",
    "how'll": "how will",
    "how's": "how is",
    "i'd": "I would",
    "i'll": "I will",
    "i'm": "I am",
    "i've": "I have",
    "isn't": "is not",
    "it'd": "it would",
    "it'll": "it will",
    "it's": "it is",
    "let's": "let us",
    "ma'am": "madam",
    "mayn't": "may not",
    "might've": "might have",
    "mightn't": "might not",
    "must've": "must have",
    "mustn't": "must not",
    "needn't": "need not",
    "o'clock": "of the clock",
    "oughtn't": "ought not",
    "shan't": "shall not",
    "she'd": "she would",
    "she'll": "she will",
    "she's": "she is",
    "should've": "should have",
    "shouldn't": "should not",
    "that'd": "that would",
    "that'll": "that will",
    "that's": "that is",
    "there'd": "there would",
    "there'll": "there will",
    "there's": "there is",
    "they'd": "they would",
    "they'll": "they will",
    "they're": "they are",
    "they've": "they have",
    "wasn't": "was not",
    "we'd": "we would",
    "we'll": "we will",
    "we're": "we are",
    "we've": "we have",
    "weren't": "were not",
    "what'll": "what will",
    "what're": "what are",
    "what's": "what is",
    "what've": "what have",
    "when's": "when is",
    "where'd": "where did",
    "where's": "where is",
    "where've": "where have",
    "who'd": "who would",
    "who'll": "who will",
    "who's": "who is",
    "who've": "who have",
    "why's": "why is",
    "won't": "will not",
    "would've": "would have",
    "wouldn't": "would not",
    "y'all": "you all",
    "you'd": "you would",
    "you'll": "you will",
    "you're": "you are",
    "you've": "you have",
    "'cause": "because",
    "'til": "until",
    "'tis": "it is",
    "'twas": "it was",
    "gimme": "give me",
    "gonna": "going to",
    "gotta": "got to",
    "lemme": "let me",
    "wanna": "want to",
}

# --- fixed values: closed word classes removed by the part-of-speech filter ---
# auxiliaries without the modals (can, could, may, might, must, shall, should,
# will, would stay)
AUXILIARIES = (
    "am", "are", "be", "been", "being", "did", "do", "does", "doing", "had",
    "has", "have", "having", "is", "was", "were",
)
DETERMINERS = (
    "a", "all", "an", "another", "any", "both", "each", "either", "every",
    "few", "half", "her", "his", "its", "many", "my", "neither", "no", "our",
    "several", "some", "such", "that", "the", "their", "these", "this",
    "those", "what", "which", "whose", "your",
)
POSSESSIVE_ENDINGS = ("'s",)

# --- fixed values: noun endings, tried in this order --------------------------
NOUN_ENDINGS = (
    ("s", ""),
    ("ses", "s"),
    ("ves", "f"),
    ("xes", "x"),
    ("zes", "z"),
    ("ches", "ch"),
    ("shes", "sh"),
    ("men", "man"),
    ("ies", "y"),
)

# --- fixed values: polarity lexicon (valence -4..4) and negators --------------
VALENCES = {
    "amazing": 2.8,
    "awful": -2.0,
    "bad": -2.5,
    "beautiful": 2.9,
    "best": 3.2,
    "boring": -1.3,
    "clown": -0.8,
    "disaster": -3.1,
    "disgusting": -2.4,
    "dull": -1.7,
    "enjoy": 2.2,
    "excellent": 2.7,
    "fail": -2.5,
    "fantastic": 2.6,
    "fun": 2.3,
    "funny": 1.9,
    "garbage": -2.2,
    "good": 1.9,
    "great": 3.1,
    "happy": 2.7,
    "hate": -2.7,
    "horrible": -2.5,
    "idiot": -2.3,
    "joy": 2.8,
    "like": 1.5,
    "lousy": -2.5,
    "love": 3.2,
    "nice": 1.8,
    "pathetic": -2.7,
    "perfect": 2.7,
    "poor": -2.1,
    "sad": -2.1,
    "stupid": -2.4,
    "terrible": -2.1,
    "terrific": 2.1,
    "trash": -1.2,
    "ugly": -2.3,
    "wonderful": 2.7,
    "worst": -3.1,
    "worthless": -1.9,
}
NEGATORS = (
    "cannot", "hardly", "neither", "never", "no", "nobody", "none", "nor",
    "not", "nothing", "nowhere", "rarely", "seldom", "without",
)
# multiplier of a negated valence and the constant that maps a sum into (-1, 1)
NEGATION_FACTOR = -0.74
POLARITY_ALPHA = 15.0
NEGATION_REACH = 3
