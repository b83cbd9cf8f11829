"""Schemas of the tables that operators take and return."""

TOKENS = "lang string, doc_id string, pos int, word string"
POSTINGS = "lang string, word string, doc_id string, tf long"
STATE = "doc_id string, lang string, pos int, word_id int, word string, topic int"
LEXICON = "l1 string, l2 string, w1 string, w2 string"
PMF = "w1 string, w2 string, p double, rk int"
WORD_LIST = "word string, ord int"
NAME_VALUE = "name string, value string"
WORD_STATS = "word string, cf double, df double, adc double, idf double, cfidf double, tcfidf double"
DOC_STATS = "doc_id string, nchars long, ntokens long, ntypes long"
FEATURES = "word string, x array<double>"
WEIGHTS = "j int, e double"
PAIRS = "w1 string, w2 string"
SCORES = "w1 string, w2 string, score double"
ANNOTATIONS = "coder string, item string, labels array<string>"
TITLES = "id string, title string"
RUNS = "key string, mrr double, p1 double, p5 double, n long"
