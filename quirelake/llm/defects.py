"""Problem 5: predictions that are no usable answer, each with its defect.

Method: a multi-label linear classifier over hashed n-grams of the prediction and features of the pair (likeness to the original,
coverage of the reference, ending, language), trained on a bounded sample of sound pairs of the corpus and on responses made from them:
cut off, copied, swapped (with another pair's answer in the same and in another language) and refused. The thresholds are set on
held-out made pairs, refusals on wordings that no training case has; what the classifier proposes an exact check confirms: for copies and languages the shares of words, for cut-offs problem 1's hazards and evidence.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.linear import Logistic, slots
from quirelake.llm.pairs import Pair, scales, target, tokens, visible
from quirelake.llm.sampling import sample
from quirelake.llm.truncation import UNSEEN, VIEW, view, viewed, weighed
from quirelake.session import cut

TRAIN_PAIRS = 2_000  # bound of the labelled sample
MISSED = 0.005  # share of held-out defects the thresholds may miss where the exact check tells
LABELS = ("refusal", "copy", "wrong_language", "truncated")

# How translators decline, in the languages of the corpus; seeds of the made refusals.
REFUSALS = (
    "I'm sorry, but I can't help with that request.", "I cannot translate this text.", "I am unable to provide a translation of this content.", "As an AI language model, I cannot assist with this translation.",
    "Sorry, I am not able to translate this passage.", "I must decline this request.", "Unfortunately I cannot comply with this request.", "This content cannot be translated by me.", "I won't be able to translate that.",
    "This text falls outside what I am allowed to translate.", "No translation can be given for this input.", "I can't provide a translated version of this passage.",
    "抱歉，我无法翻译这段内容。", "很遗憾，我不能协助完成这个请求。", "对不起，我不能翻译这段文字。", "作为一个语言模型，我无法提供该翻译。", "我无法满足这个翻译请求。", "此内容无法翻译。", "我不便提供该文本的译文。",
    "申し訳ありませんが、この文章は翻訳できません。", "このリクエストにはお応えできません。", "翻訳の依頼にはお応えできません。", "言語モデルとして、この翻訳を提供することはできません。", "この内容を翻訳することはできません。", "この内容の訳文は提供できません。",
    "К сожалению, я не могу перевести этот текст.", "Извините, я не могу помочь с этим запросом на перевод.", "Вынужден отказаться от перевода.", "Как языковая модель, я не могу предоставить этот перевод.", "Я не могу выполнить этот запрос.",
    "Es tut mir leid, aber ich kann diesen Text nicht übersetzen.", "Bei dieser Anfrage kann ich leider nicht helfen.", "Ich muss diese Übersetzung ablehnen.", "Als Sprachmodell kann ich diese Übersetzung nicht bereitstellen.", "Diesen Inhalt kann ich nicht übersetzen.",
    "Je suis désolé, mais je ne peux pas traduire ce texte.", "Il ne m'est pas possible de répondre à cette demande de traduction.", "Je dois refuser de traduire ce contenu.", "En tant que modèle de langage, je ne peux pas fournir cette traduction.", "Désolé, je ne peux pas aider pour cette traduction.", "Je n'arrive pas à traduire ce passage.",
    "Lo siento, pero no puedo traducir este texto.", "No puedo ayudar con esta solicitud de traducción.", "Debo negarme a traducir este contenido.", "Como modelo de lenguaje, no puedo proporcionar esta traducción.", "Lamentablemente no me es posible traducir esto.", "No consigo traducir este pasaje.",
    "Desculpe, mas não posso traduzir este texto.", "Não posso ajudar com este pedido de tradução.", "Devo recusar a tradução deste conteúdo.", "Como modelo de linguagem, não posso fornecer esta tradução.", "Infelizmente não é possível traduzir isto.", "Não consigo traduzir este trecho.",
    "عذرًا، لا يمكنني ترجمة هذا النص.", "لا أستطيع المساعدة في هذا الطلب.", "بصفتي نموذجًا لغويًا، لا يمكنني تقديم هذه الترجمة.",
    "क्षमा करें, मैं इस पाठ का अनुवाद नहीं कर सकता।", "मैं इस अनुरोध में सहायता नहीं कर सकता।", "एक भाषा मॉडल के रूप में मैं यह अनुवाद नहीं दे सकता।",
    "ขออภัย ฉันไม่สามารถแปลข้อความนี้ได้", "ฉันไม่สามารถช่วยเหลือตามคำขอนี้ได้", "ในฐานะโมเดลภาษา ฉันไม่สามารถให้คำแปลนี้ได้",
)
LABELS_BEFORE = ("Translation: ", "Source: ", "Text: ", "Original: ", "")
_LETTERS = re.compile(r"[^\W\d_]+")


class Languages:
    """Which language words are of, counted from references (their pair names the language) and originals."""

    def __init__(self, texts: list[tuple[str, str]]):
        words: dict[str, Counter] = defaultdict(Counter)
        for lang, text in texts:
            words[lang].update(set(self._signs(text)))
        self.names = sorted(words)
        totals = {k: sum(c.values()) for k, c in words.items()}
        self.rows = {w: i for i, w in enumerate(sorted({w for c in words.values() for w in c}), 1)}  # row 0: unknown words
        self.logs = np.zeros((len(self.rows) + 1, len(self.names)))
        for j, k in enumerate(self.names):
            self.logs[:, j] = math.log(0.05 / (totals[k] + 50))
            for w, n in words[k].items():
                self.logs[self.rows[w], j] = math.log((n + 0.05) / (totals[k] + 50))

    @staticmethod
    def _signs(text: str) -> list[str]:
        out = []
        for w in tokens(text):
            if w.isdigit():
                continue
            out += [w] if len(w) > 1 or not "぀" <= w <= "鿿" else [w, "kana" if w < "㐀" else "han"]
        return out

    def of(self, text: str) -> tuple[str, float]:
        """The likeliest language and how far it is ahead of the next."""
        if not self.names:
            return "", 0.0
        signs = self._signs(text)
        values = self.logs[[self.rows.get(w, 0) for w in signs]].sum(axis=0) / max(1, len(signs)) if signs else np.zeros(len(self.names))
        ranked = sorted(zip(values.tolist(), self.names), reverse=True)
        return ranked[0][1], ranked[0][0] - (ranked[1][0] if len(ranked) > 1 else -9.0)


def wordless(original: str | None) -> bool:
    """Null, empty, symbols or numbers alone."""
    return not visible(original) or not _LETTERS.search(original)


def names_alone(original: str, ref: str | None) -> list[str] | None:
    """The words, folded, of an original that may be names alone: every word is capitalised and the reference (if any) keeps them. None otherwise."""
    words = _LETTERS.findall(original)
    if any(not w[0].isupper() for w in words) or visible(ref) and tokens(ref) != tokens(original):
        return None
    return sorted({w.casefold() for w in words})


def _bin(x: float) -> str:
    return f"{min(10, max(0, int(x * 10 + 0.5)))}"


def pair_features(p: Pair, asked: str, lang: str, lead: float, source: str) -> dict[str, list[int]]:
    """Slots of the features of each label."""
    here = "asked" if lang == asked else "source" if lang == source else "other"
    sure = "sure" if lead > 1.0 else "likely" if lead > 0.2 else "unsure"
    ref = "r" if p.has_ref else "n"
    cov = _bin(p.covered) if p.has_ref else "-"
    both = [f"kept {_bin(p.kept)}", f"copied {_bin(p.copied)}", f"cov {cov}", f"lang {here} {sure}", f"cov lang {cov} {here}", f"ratio {ref} {min(20, int(p.ratio * 10))}"]
    cell = max(p.cells()) if not p.has_ref else p.cells()[0]
    ending = [f"end {p.ends} {p.should_end}", f"cell {cell} {p.ends}", f"part {p.partial}", f"miss {ref} {_bin(p.missing * 2)} {p.ends}", f"tail {_bin(p.tail)} {p.ends}", f"ratio {ref} {min(20, int(p.ratio * 10))} {p.ends}", f"cov {cov}"]
    w = p.words
    grams = sorted({f"w {x}" for x in w} | {f"w {x} {y}" for x, y in zip(w, w[1:])})
    unlike = "unlike" if p.kept < 0.3 and (not p.has_ref or p.covered < 0.5) else "like"
    return {"refusal": slots([*grams, f"cov {cov}", f"kept {_bin(p.kept)}", f"cov lang {cov} {here}", f"{unlike} {here} {ref}"]), "copy": slots([*both, f"kc {_bin(p.kept)} {_bin(p.copied)}"]), "wrong_language": slots([*both, f"{unlike} {here} {sure} {ref}"]), "truncated": slots(ending)}


class Judge:
    """The trained classifier with everything it looks things up in; its size is bounded by the training sample and fixed tables."""

    def __init__(self, rows: list[tuple], scale: dict[str, float]):
        self.scale = scale
        texts = [(target(path, named), ref) for _, path, named, _, _, _, ref in rows if visible(ref)]
        texts += [(src or "en", o) for _, _, _, src, o, _, _ in rows if visible(o)]
        self.languages = Languages([(k, t) for k, t in texts if k])
        self.models = {k: Logistic() for k in LABELS}
        self.least = dict.fromkeys(LABELS, 0.0)
        self._train(rows)

    def look(self, original, pred, ref, path, named, src) -> tuple[Pair, str, dict[str, list[int]], str]:
        asked = target(path, named)
        p = Pair(original, pred, ref, self.scale.get(asked, 1.0))
        lang, lead = self.languages.of(p.core)
        return p, asked, pair_features(p, asked, lang, lead, (src or "en").split("-")[0]), lang

    def _train(self, rows: list[tuple]) -> None:
        made: list[tuple[str, tuple, bool]] = []  # label, pair, held out
        sound = []
        for row in rows:
            _, path, named, src, o, pred, ref = row
            if not visible(pred) or not visible(ref) or wordless(o) or names_alone(o, ref):
                continue
            p = Pair(o, pred, ref, 1.0)
            if p.covered >= 0.75 and p.missing < 0.2 and p.ends == p.should_end and not p.added:
                sound.append(row)
        for i, (pair_id, path, named, src, o, pred, ref) in enumerate(sound):
            h = zlib.crc32(str(pair_id).encode())
            ref = ref if h % 3 else None
            asked = target(path, named)
            held = i % 5 == 4

            def case(label, text, held=held, path=path, named=named, src=src, o=o, ref=ref):
                made.append((label, (o, text, ref, path, named, src), held))

            case("", pred)
            case("", pred.rstrip(".。 "))
            if len(pred) > 12:
                at = 3 + h // 7 % (len(pred) - 5)
                case("truncated", pred[:at] + ("…" if h % 5 == 0 else ""))
            copy = LABELS_BEFORE[h // 11 % len(LABELS_BEFORE)] + o
            case("copy", copy.upper() if h % 13 == 0 else copy.replace("“", '"').replace("”", '"') if h % 2 else copy)
            words = o.split(" ")
            if len(words) > 7:  # nearly all of it
                at = h // 19 % len(words)
                case("copy", " ".join(words[:at] + words[at + 1 :]))
            other = sound[(i * 7919 + 1) % len(sound)]
            if target(other[1], other[2]) != asked:
                case("wrong_language", other[6])
            elif ref is None:
                case("", other[6])  # a sound text of another pair: without a reference nothing tells
            if h % 2 and (src or "en") != asked and other[4]:
                case("wrong_language", other[4])
            k = h // 17 % len(REFUSALS)
            words = REFUSALS[k]
            case("refusal", words.rstrip(".。") + ("!", ".", "", " (line 7)", "。")[h // 3 % 5], held=k % 4 == 3)
        if not made:
            return
        looked = [(label, self.look(*args)[2], held) for label, args, held in made]
        for k in LABELS:
            features = [f[k] for _, f, _ in looked]
            y = np.array([label == k for label, _, _ in looked], int)
            held = np.array([h for _, _, h in looked])
            self.models[k].fit([r for r, x in zip(features, held) if not x], y[~held], rounds=60)
            values = np.array([self.models[k].score(r) for r, x in zip(features, held) if x])
            self.least[k] = _threshold(values, y[held])
            if k != "refusal" and y[held].any():  # the checks of these tell by themselves: next to none shall be missed
                self.least[k] = min(self.least[k], float(np.quantile(values[y[held] == 1], MISSED)) - 1e-9)
            self.models[k].fit(features, y, rounds=15)  # the threshold stays, the model learns from the held-out cases too

    def candidate(self, original, pred, ref, path, named, src) -> tuple[str | None, bool, Pair | None]:
        """(defect but for cut-offs, whether the classifier proposes a cut-off, the pair)."""
        if not visible(pred):
            return "empty", False, None
        p = Pair(original, pred, ref, self.scale.get(target(path, named), 1.0))
        sure = p.has_ref and p.covered > 0.85  # then no check below can hold, whatever the classifier says
        if sure and p.ends:
            return None, False, p
        asked = target(path, named)
        lang, lead = self.languages.of(p.core)
        features = pair_features(p, asked, lang, lead, (src or "en").split("-")[0])
        margin = {k: self.models[k].score(features[k]) - self.least[k] for k in LABELS}
        over = {k: v > 0 for k, v in margin.items()}
        if not sure:
            foreign = over["wrong_language"] and lang != asked and margin["wrong_language"] > margin["refusal"]
            cut_short = p.partial and len(p.words) <= 3
            if over["refusal"] and p.kept < 0.5 and not foreign and not cut_short and not (p.has_ref and p.covered > 0.5):
                return "refusal", False, p
            if over["copy"] and p.kept >= 0.85 and p.copied >= 0.7:
                return "copy", False, p
            if over["wrong_language"] and lang != asked and not (p.has_ref and p.covered > (0.8 if lead > 0.3 else 0.6)):
                return "wrong_language", False, p
        return None, over["truncated"], p


def _threshold(values: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1 on held-out cases, in the middle of the gap."""
    if not y.any() or y.all():
        return 0.0
    order = np.argsort(-values, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    k = int(f1.argmax())
    v = values[order]
    return float((v[k] + v[k + 1]) / 2) if k + 1 < len(v) else float(v[k] - 1e-9)


def judge(pairs: DataFrame, scale: dict[str, float]) -> Judge:
    """Trains on at most TRAIN_PAIRS pairs, chosen by a hash of their id; of several deliveries the last."""
    rows = sample(pairs.select("pair_id", "pred_path", "target_lang", "src_lang", "original_text", "pred", "refs", "loaded_at").filter("pair_id is not null"), ["pair_id"], TRAIN_PAIRS)
    seen: dict[int, tuple] = {}
    for r in sorted(rows, key=lambda r: (r["pair_id"], r["loaded_at"] is not None, r["loaded_at"] and r["loaded_at"].timestamp(), str(r["pred"]))):
        seen[r[0]] = (*r[:6], next((x for x in (r[6] or []) if x), None))
    return Judge(list(seen.values()), scale)


def looked_at(pairs: DataFrame) -> DataFrame:
    """What problem 1 weighs, and found (defect but for cut-offs), proposed (cut-off, by the classifier), idle (nothing to translate) and
    names (words of an original that may be names alone) of each pair as last delivered."""
    scale = scales(pairs)
    shared = pairs.sparkSession.sparkContext.broadcast(judge(pairs, scale))
    schema = f"{VIEW}, found string, proposed boolean, idle boolean, names array<string>"

    @F.pandas_udf(schema)
    def look(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        j = shared.value
        for batch in batches:
            rows = []
            for path, named, original, pred, ref, src in zip(*batch):
                found, proposed, p = j.candidate(original, pred, ref, path, named, src)
                suspect = found is not None or proposed
                idle = suspect and wordless(original)
                names = names_alone(original, ref) if suspect and not idle else None
                rows.append((*(view(p) if p is not None else UNSEEN), found, proposed, idle, names))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return viewed(pairs, look, schema, True, "src_lang")


def defects(pairs: DataFrame) -> DataFrame:
    """(pair_id, defect) of each defective pair, as last delivered; pairs whose original has nothing to translate give none. Null keys
    are one pair; an empty table gives none."""
    looked = cut(looked_at(pairs))
    kinds = weighed(looked.drop("found", "proposed", "idle", "names")).select(F.col("pair_id").alias("key"), F.col("truncated"))
    defect = F.coalesce("found", F.when(F.col("proposed") & F.col("truncated"), "truncated"))
    suspects = looked.filter("(found is not null or proposed) and not idle").select("pair_id", "found", "proposed", "names")
    named = suspects.join(kinds, F.expr("pair_id <=> key"), "left").select("pair_id", "names", defect.alias("defect")).filter("defect is not null")
    # names alone: none of the words is an ordinary one, that is, stands uncapitalised in any original
    words = named.filter("names is not null").select(F.explode("names").alias("w")).distinct()
    small = F.filter(F.regexp_extract_all("original_text", F.lit(r"\p{L}+"), F.lit(0)), lambda w: w == F.lower(w))
    ordinary = pairs.select(F.explode(small).alias("w")).distinct().join(words, "w", "left_semi")
    common = named.filter("names is not null").select("pair_id", F.explode("names").alias("w")).join(ordinary, "w", "left_semi").select(F.col("pair_id").alias("key")).distinct()
    return named.join(common.withColumn("common", F.lit(True)), F.expr("pair_id <=> key"), "left").filter("names is null or common").select("pair_id", "defect")
