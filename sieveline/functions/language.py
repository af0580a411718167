"""Language by a linear classifier over character n-grams: counts of n-grams by language are added up in Spark from labelled texts, their smoothed logarithms are the weights, and a scale fitted on texts held out makes the scores probabilities."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import by_parts

#: Lengths of n-grams, n-grams of a model at most (the most frequent), and what is added to each count.
LENGTHS, GRAMS, ADDED = (2, 3), 50_000, 0.5
#: Below this confidence a text with capitals is looked at again in lower case.
UNSURE = 0.5
#: Texts whose n-grams are told together, and cells of a table of n-grams by letters; with more letters n-grams are sorted.
TEXTS_AT_ONCE, CELLS = 200, 1 << 23
#: Scales that calibration tries, and one text in so many that it holds out.
SCALES, HELD_OUT = tuple(2.0**k for k in range(-8, 3)), 10

#: Everyday sentences of our own in eight languages, from which the model is made that is there without any training.
SENTENCES: Mapping[str, str] = {
    "en": "Hello, how are you doing today? I will be home around six and we can have dinner together. Please call me back when you have a moment. The meeting was moved to Thursday morning. Your order has been shipped and should arrive within three days. Thank you for everything you did for us last week. We are going to the beach if the weather is good. Do not forget to bring the keys and the papers. There is nothing that they could have done about it. Which of these would you like to buy? She said that the children were already sleeping. Your account is now ready, click here to see what is new.",
    "fr": "Bonjour, comment vas-tu aujourd'hui ? Je serai à la maison vers six heures et nous pourrons dîner ensemble. Rappelle-moi quand tu auras un moment. La réunion est reportée à jeudi matin. Votre commande a été expédiée et devrait arriver dans les trois jours. Merci pour tout ce que vous avez fait pour nous la semaine dernière. Nous allons à la plage s'il fait beau. N'oublie pas d'apporter les clés et les papiers. Il n'y a rien qu'ils auraient pu faire. Lequel de ces livres voulez-vous acheter ? Elle a dit que les enfants dormaient déjà. Votre compte est maintenant prêt, cliquez ici pour voir les nouveautés.",
    "de": "Hallo, wie geht es dir heute? Ich bin gegen sechs zu Hause und wir können zusammen essen. Bitte ruf mich zurück, wenn du einen Moment Zeit hast. Die Besprechung wurde auf Donnerstagmorgen verschoben. Ihre Bestellung wurde verschickt und sollte in drei Tagen ankommen. Danke für alles, was ihr letzte Woche für uns getan habt. Wir gehen an den Strand, wenn das Wetter gut ist. Vergiss nicht, die Schlüssel und die Unterlagen mitzubringen. Sie hätten nichts dagegen tun können. Welches von diesen möchten Sie kaufen? Sie sagte, dass die Kinder schon schliefen. Ihr Konto ist jetzt bereit, klicken Sie hier, um zu sehen, was neu ist. Der Hund und die Katze liegen auf dem Sofa.",
    "es": "Hola, ¿cómo estás hoy? Estaré en casa sobre las seis y podemos cenar juntos. Por favor, llámame cuando tengas un momento. La reunión se ha cambiado al jueves por la mañana. Su pedido ha sido enviado y debería llegar en tres días. Gracias por todo lo que hicisteis por nosotros la semana pasada. Vamos a la playa si hace buen tiempo. No olvides traer las llaves y los papeles. No hay nada que hubieran podido hacer. ¿Cuál de estos quiere comprar? Ella dijo que los niños ya estaban durmiendo. Su cuenta ya está lista, pulse aquí para ver las novedades. El perro está en la mesa con el gato.",
    "it": "Ciao, come stai oggi? Sarò a casa verso le sei e possiamo cenare insieme. Per favore richiamami quando hai un momento. La riunione è stata spostata a giovedì mattina. Il tuo ordine è stato spedito e dovrebbe arrivare entro tre giorni. Grazie per tutto quello che avete fatto per noi la settimana scorsa. Andiamo al mare se il tempo è bello. Non dimenticare di portare le chiavi e i documenti. Non c'è niente che avrebbero potuto fare. Quale di questi vuole comprare? Ha detto che i bambini stavano già dormendo. Il suo conto è pronto, clicchi qui per vedere le novità. Questo non è il tuo, è della mia amica.",
    "pt": "Olá, como você está hoje? Estarei em casa por volta das seis e podemos jantar juntos. Por favor, me ligue quando tiver um momento. A reunião foi transferida para quinta-feira de manhã. O seu pedido foi enviado e deve chegar em três dias. Obrigado por tudo o que vocês fizeram por nós na semana passada. Vamos à praia se o tempo estiver bom. Não se esqueça de trazer as chaves e os papéis. Não há nada que eles pudessem ter feito. Qual destes você gostaria de comprar? Ela disse que as crianças já estavam dormindo. A sua conta está pronta, clique aqui para ver as novidades. Você não está só, eu também não.",
    "nl": "Hallo, hoe gaat het vandaag met je? Ik ben rond zes uur thuis en dan kunnen we samen eten. Bel me alsjeblieft terug als je even tijd hebt. De vergadering is verplaatst naar donderdagochtend. Uw bestelling is verzonden en zou binnen drie dagen moeten aankomen. Bedankt voor alles wat jullie vorige week voor ons hebben gedaan. We gaan naar het strand als het mooi weer is. Vergeet niet de sleutels en de papieren mee te nemen. Er is niets wat ze hadden kunnen doen. Welke van deze zou u willen kopen? Ze zei dat de kinderen al sliepen. Uw rekening is nu klaar, klik hier om te zien wat er nieuw is.",
    "id": "Halo, apa kabar hari ini? Saya akan berada di rumah sekitar jam enam dan kita bisa makan malam bersama. Tolong telepon saya kembali kalau ada waktu. Rapat dipindahkan ke hari Kamis pagi. Pesanan Anda sudah dikirim dan seharusnya tiba dalam tiga hari. Terima kasih atas semua yang kalian lakukan untuk kami minggu lalu. Kami pergi ke pantai kalau cuacanya bagus. Jangan lupa membawa kunci dan surat-surat. Tidak ada yang bisa mereka lakukan. Yang mana dari ini yang ingin Anda beli? Dia berkata bahwa anak-anak sudah tidur. Akun Anda sudah siap, klik di sini untuk melihat apa yang baru.",
}


def letters(text: str) -> str:
    """Words of letters with one space before, between and behind them; nothing where there is no letter."""
    said = " ".join("".join(c if c.isalpha() else " " for c in text).split())
    return f" {said} " if said else ""


def grams(text: str, lengths: Sequence[int] = LENGTHS) -> Counter[str]:
    said = letters(text)
    return Counter(said[k : k + n] for n in lengths for k in range(len(said) - n + 1))


def spelt(texts: Sequence[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(the different n-grams of texts, which of them each n-gram in the texts is, the text it stands in): those of `grams`."""
    said = [f" {t or ''} " for t in texts]
    chars = np.frombuffer("".join(said).encode("utf-32-le"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(said)), [len(x) for x in said])
    kinds, at = _told(chars)
    letter = np.array([chr(c).isalpha() for c in kinds], bool)[at]
    kept = letter.copy()
    kept[1:] |= letter[:-1] | (owner[1:] != owner[:-1])
    kept[:1] = True
    kinds, at = _told(np.where(letter, chars, ord(" "))[kept])
    owner, wide = owner[kept], max(1, len(kinds))
    names, places, owners = [], [], []
    for n in LENGTHS:
        cell, m = np.zeros(max(0, len(at) - n + 1), np.int64), max(0, len(at) - n + 1)
        for k in range(n):
            cell = cell * wide + at[k : k + m]
        whole = owner[:m] == owner[n - 1 :][:m]
        found, place = _told(cell[whole])
        spelled = np.stack([kinds[found // wide ** (n - 1 - k) % wide] for k in range(n)], axis=1).astype(np.uint32) if len(found) else np.zeros((0, n), np.uint32)
        places.append(place + len(names))
        owners.append(owner[:m][whole])
        names += spelled.view(f"<U{n}").ravel().tolist()
    return names, np.concatenate(places), np.concatenate(owners)


def _told(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values, ascending, and the place among them of each."""
    if not len(values) or values.max() >= CELLS:
        return np.unique(values, return_inverse=True)
    seen = np.zeros(int(values.max()) + 1, np.int64)
    seen[values] = 1
    return np.flatnonzero(seen), (np.cumsum(seen) - 1)[values]


@dataclass(frozen=True)
class LanguageModel:
    """weights: (n-grams, languages), logarithms of what a language's n-grams are made up of."""

    languages: tuple[str, ...]
    grams: tuple[str, ...]
    weights: np.ndarray
    scale: float = 1.0
    _places: dict = field(default_factory=dict, repr=False, compare=False)

    def scores(self, text: str) -> tuple[np.ndarray, int]:
        """(score of each language, n-grams of the text that the model knows)."""
        if not self._places:
            self._places.update((g, k) for k, g in enumerate(self.grams))
        known = [(self._places[g], n) for g, n in grams(text).items() if g in self._places]
        if not known:
            return np.zeros(len(self.languages)), 0
        at, n = np.array(known, np.int64).T
        return n @ self.weights[at], int(n.sum())

    def scores_of(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """`scores` of each text: a row of them, and the n-grams known."""
        if not self._places:
            self._places.update((g, k) for k, g in enumerate(self.grams))
        names, place, owner = spelt(texts)
        found = np.array([self._places.get(g, -1) for g in names], np.int64)
        known = found >= 0
        own = np.zeros((len(names), len(self.languages)))
        own[known] = self.weights[found[known]]
        total = [np.bincount(owner, own[place, k], len(texts)) for k in range(len(self.languages))]
        return np.stack(total, axis=1) if total else np.zeros((len(texts), 0)), np.bincount(owner, known[place], len(texts)).astype(np.int64)

    def once(self, text: str) -> tuple[str, float]:
        """(language, probability) of a text as it stands; ties go to the first language."""
        scores, n = self.scores(text)
        if not n:
            return "unknown", 0.0
        k = int(scores.argmax())
        return self.languages[k], float(1 / np.exp(self.scale * (scores - scores[k])).sum())

    def detect(self, text: str | None) -> tuple[str, float]:
        """(language, confidence); unknown and 0 for texts of fewer than two characters, and without any known n-gram. What is unsure and not in lower case is looked at in lower case, too, and the surer answer counts."""
        if text is None or len(text.strip()) < 2:
            return "unknown", 0.0
        found = self.once(text)
        if found[1] < UNSURE and not text.islower():
            low = self.once(text.lower())
            found = low if low[1] > found[1] else found
        return found[0], round(found[1], 4)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = pa.table({"gram": pa.array(self.grams, pa.string()), "weights": pa.array([w.tolist() for w in self.weights], pa.list_(pa.float64()))})
        held = spark.createDataFrame(rows, "gram string, weights array<double>")
        held.select("*", F.lit(",".join(self.languages)).alias("languages"), F.lit(self.scale).alias("scale")).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> LanguageModel:
        """A model that was saved, GRAMS rows at most."""
        rows = spark.read.parquet(path).orderBy("gram").collect()
        if not rows:
            raise ValueError(f"{path} holds no n-grams")
        return LanguageModel(tuple(rows[0]["languages"].split(",")), tuple(r["gram"] for r in rows), np.array([r["weights"] for r in rows]), rows[0]["scale"])


def weighted(counts: Mapping[str, Mapping[str, int]], languages: Sequence[str], scale: float = 1.0) -> LanguageModel:
    """A model from counts by n-gram and language: the logarithm of (count + ADDED) / (n-grams of the language + ADDED times all)."""
    names = sorted(counts)
    table = np.array([[counts[g].get(x, 0) for x in languages] for g in names], np.float64).reshape(len(names), len(languages))
    return LanguageModel(tuple(languages), tuple(names), np.log(table + ADDED) - np.log(table.sum(axis=0) + ADDED * len(names)), scale)


def _gram_totals(labelled: DataFrame, text_col: str, lang_col: str, held: Column) -> DataFrame:
    """(gram, lang, n, other): how often a language's texts have an n-gram, and how often those do that are not held. A task sends one row for each n-gram and language of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[tuple[str, str], np.ndarray] = {}
            for k in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(k, TEXTS_AT_ONCE)
                langs = part.column(0).dictionary_encode()
                spoken = langs.indices.to_numpy().astype(np.int64)
                out = part.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
                names, place, owner = spelt(part.column(1).to_pylist())
                cell = place * len(langs.dictionary) + spoken[owner]
                size = len(names) * len(langs.dictionary)
                n, less = np.bincount(cell, minlength=size), np.bincount(cell, out[owner], size)
                spoken_as = langs.dictionary.to_pylist()
                for c in np.flatnonzero(n).tolist():
                    g = names[c // len(spoken_as)], spoken_as[c % len(spoken_as)]
                    had = total.get(g, (0, 0))
                    total[g] = had[0] + int(n[c]), had[1] + int(n[c] - less[c])
            columns = [[g for g, _ in total], [x for _, x in total], [n for n, _ in total.values()], [m for _, m in total.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["gram", "lang", "n", "other"])

    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).dropna().withColumn("held", held)
    return rows.mapInArrow(run, "gram string, lang string, n long, other long").groupBy("gram", "lang").agg(F.sum("n").alias("n"), F.sum("other").alias("other"))


def _most(counts: DataFrame, most: int) -> DataFrame:
    """Of (gram, lang, n) the n-grams that are most frequent in all, ties by themselves."""
    chosen = counts.groupBy(F.col("gram").alias("g")).agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "g").limit(most)
    return counts.join(F.broadcast(chosen), F.col("gram") == F.col("g")).select("gram", "lang", "n")


def gram_counts(labelled: DataFrame, most: int = GRAMS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(gram, lang, n) of the n-grams that are most frequent in all, ties by themselves. A task sends one row for each n-gram and language it has."""
    return _most(_gram_totals(labelled, text_col, lang_col, F.lit(False)).select("gram", "lang", "n"), most)


def _model(counts: DataFrame, scale: float = 1.0) -> LanguageModel:
    """The driver holds `most` n-grams in as many languages as there are."""
    found: dict[str, dict[str, int]] = {}
    for r in counts.collect():
        found.setdefault(r["gram"], {})[r["lang"]] = r["n"]
    return weighted(found, sorted({x for by in found.values() for x in by}), scale)


def train_languages(labelled: DataFrame, most: int = GRAMS, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """A model from labelled texts. Null texts and null languages are left out; texts may repeat.

    The scale is the one of SCALES under which a tenth of the texts, held out by a hash, are most probable by the
    other texts' model; the model itself is then made of all texts.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna()
    held = F.pmod(F.xxhash64("text"), F.lit(HELD_OUT)) == 0
    counts = _gram_totals(rows, "text", "lang", held).persist()  # n-grams of all texts and of those that are not held out, in one reading
    other = _model(_most(counts.select("gram", "lang", F.col("other").alias("n")).filter("n > 0"), most))
    model = _model(_most(counts.select("gram", "lang", "n"), most))
    counts.unpersist()

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lost, n = np.zeros(len(SCALES)), 0
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(k, TEXTS_AT_ONCE)
                for scores, known, lang in zip(*other.scores_of(part.column(0).to_pylist()), part.column(1).to_pylist(), strict=True):
                    if known and lang in other.languages:
                        own = np.array(SCALES)[:, None] * (scores - scores[other.languages.index(lang)])
                        lost += np.logaddexp.reduce(own, axis=1)
                        n += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(len(SCALES)), pa.int32()), pa.array(lost), pa.array([n] * len(SCALES), pa.int64())], ["k", "lost", "n"])

    found = sorted((r["lost"], r["k"]) for r in rows.filter(held).mapInArrow(losses, "k int, lost double, n long").groupBy("k").agg(F.sum("lost").alias("lost"), F.sum("n").alias("n")).filter("n > 0").collect())
    return replace(model, scale=SCALES[found[0][1]] if found else 1.0)


@lru_cache(maxsize=1)
def default_model() -> LanguageModel:
    """The model of SENTENCES; its scale is fitted to sentences left out one at a time."""
    parts = {x: [s for s in said.replace("?", ".").split(". ") if s] for x, said in SENTENCES.items()}
    counts: dict[str, dict[str, int]] = {}
    for lang, said in parts.items():
        for s in said:
            for g, n in grams(s).items():
                by = counts.setdefault(g, {})
                by[lang] = by.get(lang, 0) + n
    lost = np.zeros(len(SCALES))
    for lang, said in parts.items():
        for s in said:
            own = grams(s)
            left = {g: by | {lang: by.get(lang, 0) - own[g]} if g in own else by for g, by in counts.items()}
            model = weighted({g: by for g, by in left.items() if any(by.values())}, tuple(SENTENCES))
            scores, _ = model.scores(s)
            lost += np.logaddexp.reduce(np.array(SCALES)[:, None] * (scores - scores[model.languages.index(lang)]), axis=1)
    return weighted(counts, tuple(SENTENCES), SCALES[int(lost.argmin())])


def detect_language(text: Column, model: LanguageModel | None = None) -> tuple[Column, Column]:
    """(language, confidence) by a model, or the one that is there without training. Both columns come of one call."""
    model = model or default_model()

    kind = pa.struct([("language", pa.string()), ("confidence", pa.float64())])

    @F.arrow_udf(T.StructType([T.StructField("language", T.StringType()), T.StructField("confidence", T.DoubleType())]))
    def found(texts: pa.Array) -> pa.Array:
        return by_parts(lambda part: [dict(zip(("language", "confidence"), model.detect(t), strict=True)) for t in part], kind, texts)

    said = found(text)
    return said["language"], said["confidence"]
