"""Word lists of the representation scan, as data.  A term that ends in * is the beginning of a word; one with a space is a phrase."""

# Fixed values.
DIMENSIONS: dict[str, dict[str, list[str]]] = {
    "gender": {
        "feminine": ["she", "her", "hers", "woman", "women", "female", "girl", "girls", "mother", "mrs", "ms", "kadın*", "kız*", "bayan*", "anne*", "hanım*", "kadin*", "kiz*"],
        "masculine": ["he", "him", "his", "man", "men", "male", "boy", "boys", "father", "mr", "erkek*", "adam*", "oğlan*", "baba*", "bey*", "oglan*"],
        "non_binary": ["they", "them", "non-binary", "nonbinary", "transgender", "genderqueer", "trans*", "ikili olmayan", "natrans*"],
    },
    "age": {
        "young": ["young", "youth", "teenager", "adolescent", "student", "junior", "graduate", "genç*", "öğrenci*", "ergen*", "yeni mezun", "genc*", "ogrenci*"],
        "middle": ["adult", "mid-career", "experienced professional", "yetişkin*", "orta yaş", "deneyimli", "yetiskin*"],
        "older": ["elderly", "senior citizen", "older adult", "retiree", "pensioner", "aged", "yaşlı*", "emekli*", "ileri yaş", "yasli*", "kıdemli*", "kidemli*"],
    },
    "ethnicity_origin": {
        "european": ["european", "western", "dutch", "german", "french", "british"],
        "asian": ["asian", "chinese", "indian", "japanese", "korean", "turkish"],
        "african": ["african", "nigerian", "kenyan", "egyptian", "moroccan"],
        "latin_american": ["latino", "latina", "hispanic", "brazilian", "mexican"],
        "middle_eastern": ["arab", "middle eastern", "persian", "lebanese", "syrian"],
    },
    "disability": {
        "disability_mentioned": ["disability", "disabled", "impairment", "wheelchair", "blind", "deaf", "neurodivergent", "autistic", "engelli*", "sakat*", "tekerlekli sandalye", "görme engel", "işitme engel", "otiz*", "nörofarklı*"],
        "accommodation": ["accessible", "accommodation", "assistive", "accessibility", "erişilebilir*", "makul uyumlaştırma", "destekleyici teknoloji", "erisilebilir*"],
    },
    "ideological": {
        "progressive": ["progressive", "liberal", "left-wing", "reformist"],
        "conservative": ["conservative", "traditional", "right-wing", "orthodox"],
        "centrist": ["centrist", "moderate", "non-partisan", "bipartisan"],
    },
    "geographic": {
        "global_north": ["united states", "europe", "canada", "australia", "japan", "netherlands", "germany", "uk"],
        "global_south": ["africa", "south asia", "latin america", "southeast asia", "sub-saharan", "developing countr"],
        "urban": ["urban", "metropolitan", "city centre", "city center", "kentsel", "şehir merkez", "büyükşehir", "sehir merkez"],
        "rural": ["rural", "countryside", "remote area", "village", "kırsal", "köy*", "taşra", "kirsal", "koy*"],
    },
    "socioeconomic": {
        "high_income": ["affluent", "wealthy", "high-income", "premium customer", "high net worth", "varlıklı*", "zengin*", "yüksek gelir", "varlikli*"],
        "low_income": ["low-income", "poverty", "underprivileged", "welfare", "unbanked", "financially vulnerable", "düşük gelir", "yoksul*", "dezavantajlı*", "sosyal yardım", "dusuk gelir", "dezavantajli*", "bankasız*"],
    },
}

# Fixed values.
NEGATIVE = [
    "risk", "risky", "fraud", "fraudulent", "default", "delinquent", "criminal", "crime", "suspicious", "threat", "danger", "dangerous", "problem", "problematic", "fail", "failure",
    "poor", "bad", "unreliable", "incapable", "unqualified", "reject", "rejected", "denied", "deny", "violent", "abuse", "illegal", "illiterate", "burden", "liability", "unstable",
    "aggressive", "lazy", "dishonest", "riskli", "dolandırıcı", "dolandirici", "sahte", "suçlu", "suclu", "suç", "şüpheli", "supheli", "tehdit", "tehlikeli", "tehlike", "sorunlu",
    "sorun", "başarısız", "basarisiz", "zayıf", "zayif", "kötü", "kotu", "güvenilmez", "guvenilmez", "yetersiz", "niteliksiz", "reddedildi", "reddedilen", "red", "elendi", "olumsuz",
    "istikrarsız", "istikrarsiz", "saldırgan", "saldirgan", "tembel", "dürüst olmayan", "yük", "yetkin olmayan", "uygunsuz", "eksik",
]

# Fixed values.
POSITIVE = [
    "reliable", "trusted", "trustworthy", "qualified", "capable", "skilled", "expert", "excellent", "strong", "successful", "success", "approve", "approved", "eligible", "valuable",
    "leader", "leadership", "innovative", "competent", "responsible", "stable", "prosperous", "talented", "diligent", "honest", "güvenilir", "guvenilir", "nitelikli", "yetkin",
    "yetenekli", "uzman", "deneyimli", "mükemmel", "mukemmel", "güçlü", "guclu", "başarılı", "basarili", "başarı", "onaylandı", "onaylandi", "uygun", "değerli", "degerli", "lider",
    "liderlik", "yenilikçi", "yenilikci", "sorumlu", "istikrarlı", "istikrarli", "çalışkan", "caliskan", "dürüst", "durust", "olumlu", "yetenek",
]

#: Words on each side of a mention that count as its context, and the mentions that a dimension needs.
CONTEXT = 12
FLOOR = 20
