"""Word lists and phrase lists.

Fixed values: results depend on every entry, and on the order of
``AI_PHRASES`` (its last 20 entries form the meta group).
"""

# Stop list of the corpus profile (50 words).
PROFILE_STOP_WORDS = [
    "the", "a", "an", "is", "in", "it", "of", "to", "and", "or", "for", "with", "on", "at", "by", "from",
    "that", "this", "was", "are", "be", "as", "he", "she", "they", "we", "i", "his", "her", "its", "our",
    "their", "but", "if", "not", "have", "had", "has", "do", "did", "does", "will", "would", "could",
    "should", "may", "might", "can", "shall", "about",
]

# The public English stop list used by the stylometric block.
ENGLISH_STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're", "you've", "you'll", "you'd",
    "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "she's", "her", "hers",
    "herself", "it", "it's", "its", "itself", "they", "them", "their", "theirs", "themselves", "what",
    "which", "who", "whom", "this", "that", "that'll", "these", "those", "am", "is", "are", "was", "were",
    "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the",
    "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about",
    "against", "between", "into", "through", "during", "before", "after", "above", "below", "to", "from",
    "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here",
    "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other",
    "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can",
    "will", "just", "don", "don't", "should", "should've", "now", "d", "ll", "m", "o", "re", "ve", "y", "ain",
    "aren", "aren't", "couldn", "couldn't", "didn", "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn",
    "hasn't", "haven", "haven't", "isn", "isn't", "ma", "mightn", "mightn't", "mustn", "mustn't", "needn",
    "needn't", "shan", "shan't", "shouldn", "shouldn't", "wasn", "wasn't", "weren", "weren't", "won", "won't",
    "wouldn", "wouldn't",
]

# Second person, modal verbs and imperative openers of the profile.
SECOND_PERSON = [
    "you", "your", "yours", "yourself", "you're", "you've", "you'll", "you'd",
]
MODAL_VERBS = [
    "can", "could", "will", "would", "shall", "should", "may", "might", "must",
]
PROFILE_IMPERATIVES = [
    "do", "dont", "don't", "please", "make", "tell", "show", "give", "stop", "start", "ignore", "act",
    "forget", "pretend", "bypass", "jailbreak",
]

# Imperative openers of the structural block.
STRUCTURAL_IMPERATIVES = [
    "ignore", "tell", "give", "write", "act", "pretend", "forget", "bypass", "do", "make", "show", "stop",
    "start", "roleplay",
]

# Unsafe-prompt keywords.
UNSAFE_KEYWORDS = [
    "ignore", "act as", "bypass", "roleplay", "pretend",
    "forget", "disregard", "override", "you are now", "DAN",
    "jailbreak", "do anything now", "no restrictions",
    "without restrictions", "as an ai", "fictional", "hypothetically",
]

# Formal transitions.
TRANSITIONS = [
    "furthermore", "moreover", "additionally", "consequently",
    "nevertheless", "nonetheless", "in addition", "as a result",
    "in conclusion", "to summarize", "it is worth noting",
    "it is important to note", "in this context", "given that",
    "on the other hand", "in contrast", "similarly",
    "significantly", "notably", "importantly",
]

# Hedging and academic words, matched on whole whitespace tokens.
HEDGING = [
    "arguably", "potentially", "essentially", "fundamentally",
    "particularly", "specifically", "inherently", "ultimately",
    "undoubtedly", "unprecedented", "comprehensive", "robust",
    "multifaceted", "nuanced", "intricate", "paradigm",
    "landscape", "framework", "leverage", "facilitate",
    "utilize", "implement", "demonstrate", "exhibit",
    "encompass", "underscore", "streamline",
    "crucial", "pivotal", "innovative", "holistic", "synergy",
    "optimize", "optimal", "efficacy", "proficiency",
    "meticulous", "methodical", "systematically", "proactively",
    "seamlessly", "strategically", "exponentially",
    "transformative", "groundbreaking", "cutting-edge",
    "aforementioned", "henceforth",
    "rewritten", "rewrite", "revised", "rephrased",
    "assumptions", "professional manner",
]

# Informal markers and first-person pronouns.
HUMAN_MARKERS = [
    "lol", "lmao", "ngl", "tbh", "imo", "smh", "bruh", "omg", "haha", "gonna", "wanna", "kinda", "gotta",
    "dunno", "yeah", "yep", "nah", "hmm", "umm", "idk", "btw",
]
FIRST_PERSON = [
    "i", "my", "me", "mine", "myself",
]

# Phrase patterns; the last 20 are the meta group.
AI_PHRASES = [
    "it is important to", "it is worth noting", "it should be noted",
    "plays a crucial role", "it is essential to", "in today's world",
    "in the modern era", "has become increasingly", "it is evident that",
    "one could argue", "this underscores the", "this highlights the",
    "delve into", "delve deeper", "in the realm of",
    "a myriad of", "at the forefront", "pave the way",
    "it cannot be overstated", "to shed light on",
    "the advent of", "the emergence of", "the proliferation of",
    "serves as a testament", "a testament to",
    "from a broader perspective", "in light of",
    "navigating the complexities", "fostering a sense of",
    "below is your request", "below is a rewritten", "below is the rewritten",
    "rewritten in a clear", "rewritten in a professional",
    "here is a revised", "here is the revised", "here's a revised",
    "here is a rewritten", "here is the rewritten",
    "without adding extra assumptions", "without making assumptions",
    "sure! here", "sure, here", "of course! here", "absolutely! here",
    "certainly! here", "certainly, here",
    "i'd be happy to", "i'll help you", "let me help",
    "here's a comprehensive", "here is a comprehensive",
    "here's a detailed", "here is a detailed",
    "conduct a comprehensive review", "comprehensive review of",
    "identify the root cause", "root cause of the",
    "ensure that all", "ensure consistency",
    "please find below", "as per your request",
    "hope this helps", "let me know if", "feel free to",
]
META_PHRASES = AI_PHRASES[-20:]

# Formulaic sentence openers.
STARTERS = [
    "in conclusion,", "moreover,", "furthermore,", "additionally,",
    "however,", "nevertheless,", "consequently,", "similarly,",
    "in summary,", "to summarize,", "in essence,", "ultimately,",
    "it is important", "it is worth", "it is essential",
    "this is because", "this demonstrates", "this highlights",
    "one of the most", "one of the key", "the importance of",
    "by leveraging", "by utilizing", "by implementing",
    "as a result,", "on the other hand,", "in other words,",
]

# Contraction suffixes.
CONTRACTIONS = ["n't", "'m", "'re", "'ve", "'ll", "'d", "'s"]
