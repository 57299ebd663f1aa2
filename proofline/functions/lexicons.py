"""Word lists and patterns that results must agree on; all of them are fixed values."""

# Phrases that mark a turn, a cliffhanger and a conflict in a sentence.
TWIST_CUES = [
    "ternyata", "tak disangka", "tidak disangka", "mengejutkan", "rahasia", "sebenarnya", "kebenaran", "twist", "wahyu", "terungkap",
    "rupanya", "plot twist", "revealed", "turns out", "secretly",
]
CLIFF_CUES = [
    "bersambung", "akhir bab", "muncul", "tiba-tiba", "menghilang", "kembali", "menantang", "mengancam", "tantangan", "cliffhanger",
    "to be continued", "suddenly", "appears", "next chapter",
]
CONFLICT_CUES = [
    "melawan", "bertarung", "menyerang", "konflik", "musuh", "ancaman", "harus", "dipaksa", "gagal", "kalah", "bahaya", "berbahaya",
    "membunuh", "fight", "battle", "enemy", "threat", "must", "forced", "danger",
]

# The words of each tag of a narration, and the words of a tag that another one brings.
TAG_WORDS = {
    "action": [
        "attack", "attacked", "attacks", "hit", "struck", "strike", "fight", "fought", "run", "jump", "fall", "battle", "chase", "serang",
        "menyerang", "memukul", "merampas", "menebas", "bertarung", "berlari", "melompat", "jatuh", "kejar", "mengejar",
    ],
    "reveal": ["reveal", "finally", "opened", "awakens", "appears", "appeared", "discovers", "ternyata", "akhirnya", "muncul", "terbuka", "bangkit", "menemukan"],
    "explosion": ["explosion", "explode", "blast", "fire", "destroy", "impact", "ledakan", "meledak", "hancur", "menghancurkan", "dampak"],
    "thinking": ["think", "thinks", "remember", "wonder", "realize", "considers", "berpikir", "teringat", "bertanya", "menyadari", "mempertimbangkan"],
    "weapon": ["sword", "axe", "blade", "weapon", "bow", "spear", "gun", "pedang", "kapak", "bilah", "senjata", "busur", "tombak", "pistol"],
    "monster": ["dragon", "monster", "demon", "beast", "boss", "ogre", "creature", "naga", "iblis", "binatang", "bos", "makhluk"],
    "dialogue": ["dialogue", "says", "tells"],
    "victory": ["victory", "victorious", "wins", "won", "triumph", "defeated", "menang", "kemenangan", "mengalahkan", "ditaklukkan"],
}
ATTACK_WORDS = ["attack", "attacked", "attacks", "strike", "struck", "hit"]

# Frequent words of the two languages that a narration may have.
INDONESIAN = ["yang", "dan", "dengan", "untuk", "dari", "ini", "itu", "pada", "akan", "sudah", "karena", "kemudian", "akhirnya"]
ENGLISH = [
    "the", "and", "with", "for", "from", "this", "that", "is", "was", "he", "she", "they", "we", "but", "when", "while", "every", "one", "person",
    "appears", "forcing", "only", "enters", "fails",
]

# What gives an outcome away, and what is said instead if nothing else is left.
REVEAL = r"\b(ternyata|sebenarnya|rupanya|akhirnya\s+\w+\s+(?:mati|menang|kalah)|turns out)\b"
TEASE = "Dan justru di titik itu arah ceritanya berubah, tapi bagian itu lebih baik kamu baca sendiri."

# Calls to the viewer as patterns of a passage and as phrases of a narrative, and phrases of hype.
CALLS = [
    r"\bsubscribe\b", r"\bfollow[\s-]+for[\s-]+more\b", r"\bplease\s+like\b", r"\blike\s+this\s+video\b", r"\b(?:drop|hit)\s+(?:a\s+)?like\b",
    r"\bplease\s+comment\b", r"\bcomment\s+below\b", r"\bleave\s+(?:a\s+)?comment\b", r"\btell\s+us\s+in\s+comments\b",
]
CALL_MARKERS = ["like this video", "subscribe", "follow for more", "watch until the end"]
HYPE_MARKERS = ["epic battle", "unstoppable attack", "insane power"]
