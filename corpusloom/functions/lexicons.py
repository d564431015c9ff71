"""Word lists and table layouts that results depend on.

Fixed values: every list here is data that the analyses are defined by.
"""


STOPWORDS_STRICT = [
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "with", "at", "by", "from", "is", "are", "was",
    "were", "be", "been", "being", "as", "that", "this", "these", "those", "it", "its", "their", "his", "her", "they",
    "them", "he", "she", "we", "you", "i", "not", "but", "if", "then", "than", "into", "about", "after", "before",
    "during", "up", "down", "out", "over", "have", "has", "had", "do", "does", "did", "can", "could", "will", "would",
    "may", "might", "must", "should", "dan", "atau", "yang", "di", "ke", "dari", "untuk", "dengan", "pada", "adalah",
    "itu", "ini", "dalam", "oleh", "sebagai", "juga", "akan", "telah", "lebih", "karena", "serta", "tidak", "bagi",
    "antara", "agar", "namun", "ia", "mereka", "kami", "kita", "saya", "anda", "usai", "jadi", "sebut", "kata",
    "menurut", "tersebut", "hingga", "kepada", "dapat", "boleh", "perlu", "harus", "masih", "atas", "setelah",
    "sebelum", "ketika", "bukan", "yakni", "reuters", "afp", "ap", "kompas", "tempo", "bernama", "thejakartapost",
    "thestar", "share", "facebook", "twitter", "whatsapp", "telegram", "instagram", "youtube", "follow", "subscribe",
    "channel", "comment", "comments", "video", "photo", "breaking", "news", "read", "also", "more", "our", "please",
    "email", "valid", "click", "log", "sign", "newsletter",
]

STOPWORDS_CORE = [
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "with", "at", "by", "from", "is", "are", "was",
    "were", "be", "been", "being", "as", "that", "this", "these", "those", "it", "its", "their", "his", "her", "they",
    "them", "he", "she", "we", "you", "i", "not", "but", "if", "then", "than", "into", "about", "after", "before",
    "during", "up", "down", "out", "over", "have", "has", "had", "do", "does", "did", "can", "could", "will", "would",
    "may", "might", "must", "should", "am", "dan", "atau", "yang", "di", "ke", "dari", "untuk", "dengan", "pada",
    "adalah", "itu", "ini", "dalam", "oleh", "sebagai", "juga", "akan", "telah", "lebih", "karena", "serta", "tidak",
    "bagi", "antara", "agar", "namun", "ia", "mereka", "kami", "kita", "saya", "anda", "usai", "jadi", "sebut", "kata",
    "menurut", "tersebut", "hingga", "kepada", "dapat", "boleh", "perlu", "harus", "masih", "atas", "setelah",
    "sebelum", "ketika", "bukan", "и", "а", "но", "или", "в", "во", "на", "по", "с", "со", "к", "ко", "из", "за", "для",
    "о", "об", "от", "до", "это", "как", "что", "бы", "же", "ли", "не", "ни", "он", "она", "они", "мы", "вы", "я",
    "его", "ее", "их",
]

COUNTRY_TERMS = {
    "usa": [
        "usa", "us", "u.s", "united", "states", "america", "american", "washington", "amerika", "serikat", "syarikat",
        "white", "house", "pentagon", "biden", "trump", "congress", "senate", "сша", "америка", "вашингтон",
    ],
    "russia": [
        "russia", "russian", "rusia", "moscow", "kremlin", "putin", "lavrov", "россия", "москва", "кремль", "путин",
    ],
    "china": [
        "china", "chinese", "cina", "tiongkok", "beijing", "xi", "jinping", "ccp", "cpc", "prc", "yuan", "taiwan",
        "xinjiang", "китай", "кпк", "пекин", "юань",
    ],
}

SOURCE_LANG_DEFAULT = {
    "Antara": "id",
    "Kompas Indonesia": "id",
    "Tempo": "id",
    "The Jakarta Post": "en",
    "Astro Awani": "ms",
    "Bernama": "ms",
    "The Star": "en",
    "The Edge Malaysia": "en",
}

LANG_HINTS = {
    "en": ["the", "and", "of", "to", "in", "for", "with", "on", "is", "are", "was", "were", "said", "government"],
    "id": ["dan", "yang", "di", "ke", "dari", "untuk", "dengan", "adalah", "tidak", "akan", "menurut", "pemerintah"],
    "ms": [
        "dan", "yang", "di", "ke", "dari", "untuk", "dengan", "adalah", "tidak", "akan", "kerajaan", "menteri",
        "syarikat",
    ],
    "ru": ["и", "в", "на", "с", "по", "для", "что", "это", "как", "был", "были", "заявил", "правительство", "президент"],
}

FRAME_LEXICONS = {
    "security_threat": [
        "threat", "risk", "attack", "war", "conflict", "ancaman", "risiko", "serangan", "perang", "konflik",
    ],
    "economy_trade": [
        "trade", "tariff", "market", "investment", "economy", "dagang", "tarif", "pasar", "investasi", "ekonomi",
    ],
    "diplomacy_partnership": [
        "cooperation", "partnership", "dialogue", "agreement", "kerja", "sama", "kemitraan", "dialog", "kesepakatan",
    ],
    "governance_values": [
        "democracy", "sovereignty", "stability", "law", "demokrasi", "kedaulatan", "stabilitas", "hukum",
    ],
}

SENT_POS = [
    "cooperation", "partnership", "stability", "growth", "peace", "agreement", "support", "progress", "benefit",
    "kerja", "sama", "stabil", "pertumbuhan", "damai", "kesepakatan", "dukungan", "kemajuan", "manfaat",
]

SENT_NEG = [
    "threat", "crisis", "conflict", "war", "attack", "sanction", "decline", "risk", "tension", "failure", "violence",
    "ancaman", "krisis", "konflik", "perang", "serangan", "sanksi", "penurunan", "risiko", "ketegangan", "gagal",
    "kekerasan",
]

SENT_POS_BY_LANG = {
    "en": ["cooperation", "partnership", "stability", "growth", "peace", "agreement", "support", "progress", "benefit"],
    "id": ["kerja", "sama", "stabil", "pertumbuhan", "damai", "kesepakatan", "dukungan", "kemajuan", "manfaat"],
    "ms": ["kerja", "sama", "stabil", "pertumbuhan", "damai", "persetujuan", "sokongan", "kemajuan", "manfaat"],
    "ru": [
        "сотрудничество", "партнерство", "стабильность", "рост", "мир", "соглашение", "поддержка", "прогресс", "выгода",
    ],
}

SENT_NEG_BY_LANG = {
    "en": [
        "threat", "crisis", "conflict", "war", "attack", "sanction", "decline", "risk", "tension", "failure",
        "violence",
    ],
    "id": [
        "ancaman", "krisis", "konflik", "perang", "serangan", "sanksi", "penurunan", "risiko", "ketegangan", "gagal",
        "kekerasan",
    ],
    "ms": [
        "ancaman", "krisis", "konflik", "perang", "serangan", "sekatan", "penurunan", "risiko", "ketegangan", "gagal",
        "keganasan",
    ],
    "ru": [
        "угроза", "кризис", "конфликт", "война", "атака", "санкции", "спад", "риск", "напряженность", "провал",
        "насилие",
    ],
}

FRAME_LEXICONS_BY_LANG = {
    "en": {
        "security_threat": ["threat", "risk", "attack", "war", "conflict"],
        "economy_trade": ["trade", "tariff", "market", "investment", "economy"],
        "diplomacy_partnership": ["cooperation", "partnership", "dialogue", "agreement"],
        "governance_values": ["democracy", "sovereignty", "stability", "law"],
    },
    "id": {
        "security_threat": ["ancaman", "risiko", "serangan", "perang", "konflik"],
        "economy_trade": ["dagang", "tarif", "pasar", "investasi", "ekonomi"],
        "diplomacy_partnership": ["kerja", "sama", "kemitraan", "dialog", "kesepakatan"],
        "governance_values": ["demokrasi", "kedaulatan", "stabilitas", "hukum"],
    },
    "ms": {
        "security_threat": ["ancaman", "risiko", "serangan", "perang", "konflik"],
        "economy_trade": ["dagangan", "tarif", "pasaran", "pelaburan", "ekonomi"],
        "diplomacy_partnership": ["kerjasama", "kemitraan", "dialog", "persetujuan", "kerja", "sama"],
        "governance_values": ["demokrasi", "kedaulatan", "kestabilan", "undang"],
    },
    "ru": {
        "security_threat": ["угроза", "риск", "атака", "война", "конфликт"],
        "economy_trade": ["торговля", "тариф", "рынок", "инвестиции", "экономика"],
        "diplomacy_partnership": ["сотрудничество", "партнерство", "диалог", "соглашение"],
        "governance_values": ["демократия", "суверенитет", "стабильность", "закон"],
    },
}

PERSUASION_MARKERS = {
    "modality_obligation": ["must", "should", "need", "harus", "wajib", "perlu"],
    "modality_possibility": ["can", "could", "may", "might", "dapat", "bisa", "boleh"],
    "authority_reference": [
        "official", "minister", "president", "government", "pejabat", "menteri", "presiden", "pemerintah",
    ],
    "evaluation_positive": ["strategic", "important", "vital", "strong", "strategis", "penting", "kuat"],
    "evaluation_negative": ["dangerous", "illegal", "aggressive", "berbahaya", "ilegal", "agresif"],
}

PERSUASION_MARKERS_BY_LANG = {
    "en": {
        "modality_obligation": ["must", "should", "need"],
        "modality_possibility": ["can", "could", "may", "might"],
        "authority_reference": ["official", "minister", "president", "government"],
        "evaluation_positive": ["strategic", "important", "vital", "strong"],
        "evaluation_negative": ["dangerous", "illegal", "aggressive"],
    },
    "id": {
        "modality_obligation": ["harus", "wajib", "perlu"],
        "modality_possibility": ["dapat", "bisa", "boleh"],
        "authority_reference": ["pejabat", "menteri", "presiden", "pemerintah"],
        "evaluation_positive": ["strategis", "penting", "kuat"],
        "evaluation_negative": ["berbahaya", "ilegal", "agresif"],
    },
    "ms": {
        "modality_obligation": ["mesti", "harus", "wajib", "perlu"],
        "modality_possibility": ["boleh", "dapat", "mungkin"],
        "authority_reference": ["pegawai", "menteri", "presiden", "kerajaan"],
        "evaluation_positive": ["strategik", "penting", "kuat"],
        "evaluation_negative": ["berbahaya", "haram", "agresif"],
    },
    "ru": {
        "modality_obligation": ["должен", "должны", "нужно", "необходимо", "обязан"],
        "modality_possibility": ["может", "могут", "возможно", "способен"],
        "authority_reference": ["официальный", "министр", "президент", "правительство", "власти"],
        "evaluation_positive": ["стратегический", "важный", "сильный", "конструктивный"],
        "evaluation_negative": ["опасный", "незаконный", "агрессивный", "деструктивный"],
    },
}

IDEOLOGY_MARKERS = {
    "ideol": [
        "sovereignty", "kedaulatan", "суверенитет", "national", "nasional", "bangsa", "identity", "identitas",
        "pancasila", "bhinneka", "unity", "persatuan", "stability", "stabilitas", "islamic", "islam", "development",
        "pembangunan",
    ],
    "prec": [
        "pancasila", "bhinneka", "nato", "asean", "kremlin", "white", "house", "washington", "beijing", "moscow",
        "putin", "biden", "trump", "xi", "jinping",
    ],
    "slog": [
        "for", "nation", "national", "interest", "demi", "bangsa", "negara", "unity", "persatuan", "stability",
        "keamanan", "security", "kestabilan",
    ],
    "dich": [
        "we", "they", "our", "their", "us", "them", "kita", "kami", "mereka", "мы", "они", "ourselves", "themselves",
        "sendiri",
    ],
}

EMOTION_MARKERS = {
    "weak": ["concern", "worry", "uncertain", "harap", "khawatir", "cemas", "risau", "тревога", "сомнение"],
    "medium": ["fear", "anger", "pride", "hope", "trust", "marah", "bangga", "percaya", "надежда", "гнев"],
    "strong": [
        "panic", "threat", "catastrophe", "shock", "outrage", "terror", "ancaman", "krisis", "ужас", "катастрофа",
    ],
}

EVALUATION_MARKERS = {
    "rational": [
        "strategic", "important", "legal", "effective", "necessary", "stabil", "penting", "sah", "эффективный",
        "рациональный", "стратегический",
    ],
    "emotional": [
        "outrageous", "heroic", "shameful", "brutal", "berbahaya", "agresif", "kejam", "ужасный", "героический",
    ],
    "explicit": ["must", "should", "need", "harus", "wajib", "perlu", "clearly", "obviously", "очевидно", "должен"],
    "implicit": ["allegedly", "claimed", "reportedly", "so-called", "seolah", "katanya", "будто", "якобы"],
}

METAPHOR_MARKERS = {
    "weak": ["wave", "path", "bridge", "shield", "gelombang", "jembatan", "мост", "волна"],
    "medium": ["battle", "arena", "storm", "engine", "medan", "badai", "арена", "буря"],
    "strong": ["chess", "wounded", "organism", "frontline", "perang", "раненый", "шахмат"],
}

REF_KEYWORDS = {
    "China": [
        "China", "Chinese", "Beijing", "Xi Jinping", "Communist Party of China", "CPC", "CCP", "PRC", "yuan",
        "Belt and Road", "BRI", "Chinese economy", "Chinese culture", "Huawei", "Taiwan", "Tiongkok", "Cina",
        "South China Sea", "Xinjiang", "Hong Kong", "Китай", "китайский", "Пекин", "Си Цзиньпин", "КПК", "КНР",
        "китайская экономика", "китайская культура",
    ],
    "USA": [
        "United States", "US", "U.S.", "America", "American", "Washington", "White House", "Biden", "Trump", "dollar",
        "Pentagon", "Congress", "NATO", "Amerika Serikat", "Amerika Syarikat", "США", "Соединенные Штаты", "Америка",
        "американский", "Вашингтон", "Белый дом", "Пентагон", "Конгресс",
    ],
    "Russia": [
        "Russia", "Russian", "Moscow", "Kremlin", "Putin", "ruble", "Russian economy", "Russian military",
        "Ukraine war", "sanctions against Russia", "Rusia", "Россия", "российский", "Москва", "Кремль", "Путин",
        "рубль", "российская экономика", "санкции против России",
    ],
}

RUBRIC_POS_LEX = [
    "partner", "cooperation", "support", "stability", "opportunity", "contribution", "leadership", "development",
    "trust", "constructive", "benefit", "growth", "peace", "responsible", "legitimate", "kemitraan", "kerja sama",
    "kerjasama", "dukungan", "sokongan", "stabilitas", "kestabilan", "peluang", "kontribusi", "kepemimpinan",
    "kepimpinan", "pembangunan", "kepercayaan", "konstruktif", "membina", "manfaat", "faedah", "pertumbuhan", "damai",
    "aman", "bertanggung jawab", "bertanggungjawab", "sah", "партнер", "партнерство", "сотрудничество", "поддержка",
    "стабильность", "возможность", "вклад", "лидерство", "развитие", "доверие", "конструктивный", "выгода", "рост",
    "мир", "ответственный", "легитимный",
]

RUBRIC_NEG_LEX = [
    "threat", "aggression", "pressure", "crisis", "interference", "destabilize", "risk", "failure", "repression",
    "coercion", "conflict", "instability", "violates", "authoritarian", "hegemony", "ancaman", "agresi", "tekanan",
    "krisis", "campur tangan", "risiko", "kegagalan", "represi", "paksaan", "konflik", "ketidakstabilan", "pelanggaran",
    "otoriter", "hegemoni", "ugutan", "угроза", "агрессия", "давление", "кризис", "вмешательство", "дестабилизация",
    "риск", "провал", "репрессии", "принуждение", "конфликт", "нестабильность", "нарушает", "авторитарный", "гегемония",
]

RUBRIC_POS_ACTION = [
    "supports", "cooperates", "contributes", "stabilizes", "protects", "invests", "develops", "mendukung", "menyokong",
    "bekerja sama", "berkerjasama", "berkolaborasi", "berkontribusi", "menstabilkan", "melindungi", "berinvestasi",
    "mengembangkan", "поддерживает", "сотрудничает", "вкладывает", "инвестирует", "развивает", "стабилизирует",
    "защищает",
]

RUBRIC_NEG_ACTION = [
    "threatens", "pressures", "interferes", "attacks", "destabilizes", "violates", "controls", "mengancam", "menekan",
    "campur tangan", "menyerang", "mendestabilisasi", "melanggar", "mengontrol", "mengawal", "угрожает", "давит",
    "вмешивается", "атакует", "дестабилизирует", "нарушает", "контролирует",
]

RUBRIC_POS_CONSEQUENCE = [
    "development", "stability", "security", "growth", "peace", "partnership", "opportunities", "pembangunan",
    "stabilitas", "kestabilan", "keamanan", "pertumbuhan", "damai", "kemitraan", "peluang", "развитие", "стабильность",
    "безопасность", "рост", "мир", "партнерство", "возможности",
]

RUBRIC_NEG_CONSEQUENCE = [
    "instability", "tension", "conflict", "crisis", "dependence", "sovereignty risk", "ketidakstabilan", "ketegangan",
    "konflik", "krisis", "ketergantungan", "risiko kedaulatan", "нестабильность", "напряженность", "конфликт", "кризис",
    "зависимость", "риск суверенитету", "риск суверенитета",
]

RUBRIC_POS_FRAME = [
    "legitimate partner", "responsible actor", "defender of sovereignty", "stabilizing power", "mitra yang sah",
    "aktor bertanggung jawab", "pembela kedaulatan", "kekuatan penstabil", "легитимный партнер", "ответственный актор",
    "защитник суверенитета", "стабилизирующая сила",
]

RUBRIC_NEG_FRAME = [
    "hegemon", "aggressor", "authoritarian regime", "violator of international law", "destabilizing force", "hegemoni",
    "agresor", "rezim otoriter", "pelanggar hukum internasional", "kekuatan destabilisasi", "гегемон", "агрессор",
    "авторитарный режим", "нарушитель международного права", "дестабилизирующая сила",
]

AUTHORITY_CUES = [
    "according to", "official", "minister", "president", "government", "spokesperson", "analyst", "diplomat", "menurut",
    "pemerintah", "kerajaan", "menteri", "jurucakap", "analis", "президент", "министр", "правительство", "по словам",
    "заявил", "сообщил", "дипломат",
]

NEUTRAL_ACTION_CUES = [
    "said", "stated", "announced", "met", "meeting", "discussed", "agreed", "visited", "reported", "mengatakan",
    "menyatakan", "bertemu", "membahas", "setuju", "melaporkan", "заявил", "сообщил", "обсудил", "встретился",
    "провел встречу",
]

IDEOLOGICAL_TERMS = [
    "democracy", "sovereignty", "freedom", "authoritarianism", "communism", "imperialism", "colonialism",
    "neocolonialism", "multipolarity", "rules-based order", "regime", "dictatorship", "hegemony", "communist party",
    "liberal order", "authoritarian state", "violates international law", "defends sovereignty",
    "threatens regional stability", "protects national interests", "демократия", "суверенитет", "свобода",
    "авторитаризм", "коммунизм", "империализм", "колониализм", "неоколониализм", "многополярность",
    "порядок, основанный на правилах", "режим", "диктатура", "гегемония", "коммунистическая партия",
    "либеральный порядок", "авторитарное государство", "нарушает международное право", "защищает суверенитет",
    "угрожает региональной стабильности", "защищает национальные интересы", "demokrasi", "kedaulatan", "kebebasan",
    "otoritarianisme", "komunisme", "imperialisme", "kolonialisme", "neokolonialisme", "multipolaritas",
    "aturan berbasis tatanan", "rezim", "kediktatoran", "hegemoni", "partai komunis", "tatanan liberal",
    "negara otoriter", "melanggar hukum internasional", "membela kedaulatan", "mengancam stabilitas regional",
    "melindungi kepentingan nasional",
]

EMOTIONAL_TERMS = {
    "weak": [
        "concern", "problem", "support", "challenge", "tension", "kebimbangan", "keprihatinan", "masalah", "dukungan",
        "sokongan", "cabaran", "tantangan", "ketegangan", "озабоченность", "проблема", "поддержка", "вызов",
        "напряжение",
    ],
    "medium": [
        "threat", "anger", "fear", "pressure", "conflict", "criticism", "ancaman", "kemarahan", "ketakutan", "tekanan",
        "konflik", "kritik", "угроза", "гнев", "страх", "давление", "конфликт", "критика",
    ],
    "strong": [
        "catastrophe", "betrayal", "aggression", "triumph", "heroic", "disaster", "collapse", "bencana",
        "pengkhianatan", "agresi", "kejayaan", "heroik", "runtuh", "катастрофа", "предательство", "агрессия", "триумф",
        "героический", "бедствие", "коллапс",
    ],
}

METAPHOR_TERMS = {
    "war": [
        "battle", "fight", "attack", "defense", "frontline", "pertempuran", "bertarung", "serangan", "pertahanan",
        "garis depan", "битва", "борьба", "атака", "оборона", "фронт",
    ],
    "organism": [
        "healthy economy", "sick system", "recovery", "virus", "ekonomi sehat", "sistem sakit", "pemulihan",
        "восстановление",
    ],
    "movement": ["growth path", "wave", "flow", "collapse", "jalur pertumbuhan", "gelombang", "aliran", "runtuh"],
    "game": ["player", "move", "strategy", "chessboard", "pemain", "langkah", "strategi", "papan catur"],
    "personification": ["wants", "fears", "pressures", "ingin", "takut", "menekan", "хочет", "боится", "давит"],
}

LEXICON_SCHEMAS = {
    "ideological_markers.csv": [
        "term", "lemma", "language", "category", "semantic_zone", "polarity_hint", "strength_hint", "context_dependent",
        "examples", "exclude_patterns", "source", "verified",
    ],
    "emotional_markers.csv": [
        "term", "lemma", "language", "emotion_type", "intensity_level", "weight", "polarity_hint", "context_dependent",
        "examples", "exclude_patterns", "source", "verified",
    ],
    "metaphor_markers.csv": [
        "term", "lemma", "language", "metaphor_model", "source_domain", "target_domain", "conventionality",
        "default_strength", "context_dependent", "examples", "exclude_patterns", "source", "verified",
    ],
    "evi_lexicon.csv": [
        "term", "lemma", "language", "evaluation_type", "polarity", "strength", "category", "context_dependent",
        "examples", "exclude_patterns", "source", "verified",
    ],
    "actor_actions.csv": [
        "verb_or_phrase", "lemma", "language", "action_polarity", "action_strength", "typical_subject",
        "typical_object", "examples", "verified",
    ],
    "consequence_markers.csv": [
        "term_or_phrase", "language", "consequence_polarity", "consequence_domain", "strength", "examples", "verified",
    ],
    "ideological_frames.csv": ["frame_name", "frame_type", "polarity", "keywords", "examples", "verified"],
    "salience_patterns.csv": ["pattern", "pattern_type", "salience_value", "examples", "verified"],
    "technical_mention_patterns.csv": ["pattern", "technical_type", "salience_value", "examples", "verified"],
    "candidate_terms.csv": [
        "candidate_id", "candidate_term", "lemma", "language", "proposed_dictionary", "proposed_category", "frequency",
        "contexts_count", "example_contexts", "cooccurring_ref_countries", "polarity_hint", "confidence_score",
        "status",
    ],
    "verified_terms.csv": [
        "candidate_id", "term", "lemma", "language", "dictionary", "category", "approved_at", "notes",
    ],
    "rejected_terms.csv": ["candidate_id", "term", "lemma", "language", "proposed_dictionary", "reason", "rejected_at"],
    "dictionary_change_log.csv": ["timestamp", "action", "term", "lemma", "dictionary", "category", "status", "details"],
}
