"""Hand-checked holdout and rule-made training examples for the kind of a text."""

from __future__ import annotations

import random

#: Checked by hand: (kind, text).  Every second one calibrates, the others measure accuracy; none is used for training.
HOLDOUT = [
    ("prose", "The new dose was well tolerated. Most patients slept better after two weeks, and none of them asked to leave the trial."),
    ("prose", "We measured the pressure before and after exercise. It rose in seven of the ten volunteers, but the rise was small and did not last."),
    ("prose", "Background: little is known about the long-term course.\n\nMethods: we followed 40 adults for three years.\n\nResults: nine of them relapsed within\nthe first year, and the rest stayed well."),
    ("prose", "Die Probanden erhielten die Substanz über sechs Wochen. Nach dem Absetzen stieg der Blutdruck wieder an, und zwei von ihnen brachen ab."),
    ("prose", "Los pacientes mejoraron tras la segunda semana. No se observó ningún efecto sobre el peso, según el informe de la unidad."),
    ("prose", "Les malades ont reçu le produit pendant un mois. Le poids n'a pas changé, et la douleur est revenue chez trois d'entre eux."),
    ("prose", "Препарат снижал давление у всех больных. После отмены боль вернулась, и двое из них вышли из исследования."),
    ("prose", "患者每天服药一次，持续四周。没有出现严重的不良反应，但有三人退出研究。"),
    ("prose", "薬を止めると症状は戻った。ラットでは効果が見られなかったが、理由は分かっていない。"),
    ("prose", "दवा लेने के बाद दर्द कम हुआ। दो रोगियों में असर नहीं दिखा और उन्हें बाहर किया गया।"),
    ("prose", "تلقى المرضى الدواء مرة في اليوم. اختفت الأعراض بعد أسبوعين، ولم ينسحب أحد من الدراسة."),
    ("prose", "ผู้ป่วยได้รับยาวันละครั้ง อาการดีขึ้นในสองสัปดาห์ ไม่พบผลข้างเคียงที่ร้ายแรง"),
    ("prose", "In the second arm the drug was given by mouth. The table below lists the doses.\nA 5 mg\nB 10 mg\nAll doses were taken with water in the morning, and the nurses noted the time of each."),
    ("prose", "As noted for KXR-4, loss of the gene slowed the repair of the wound, which argues against a role for ZTM9 in the skin."),
    ("list", "Keywords: asthma; bronchitis; inhaled steroids; peak flow; smoking; spirometry; airway disease; cohort study"),
    ("list", "- aspirin\n- ibuprofen\n- paracetamol\n- codeine\n- tramadol\n- morphine\n- fentanyl"),
    ("list", "1. heart\n2. left kidney\n3. right kidney\n4. liver\n5. spleen\n6. pancreas\n7. small intestine\n8. colon"),
    ("list", "fever\ndry cough\nchest pain\nnight sweats\nweight loss\nskin rash\njoint pain\nheadache\nnausea"),
    ("list", "[1] Miller A, Jones B. Sleep and memory. Journal of Rest 1999;12:34\n[2] Brown C. Dreams in the elderly. Archives of Sleep 2003;4:112\n[3] Green D, White E. Naps. Annals of Rest 2010;7:9"),
    ("list", "ABC1: a transporter\nBMI: body mass index\nCT: computed tomography\nECG: electrocardiogram\nHR: heart rate\nMRI: magnetic resonance imaging"),
    ("list", "Smith, Jones, Miller, Brown, Taylor, Wilson, Davies, Evans, Thomas, Johnson, Roberts, Walker, Wright, Robinson, Thompson"),
    ("list", "Materials:\na) sodium chloride, 5 g\nb) glucose, 20 g\nc) agar, 15 g\nd) yeast extract, 5 g\ne) peptone, 10 g"),
    ("table", "drug\tdose\tn\nA\t5\t20\nB\t10\t22\nC\t20\t19\nD\t40\t25"),
    ("table", "| group | mean | sd |\n| --- | --- | --- |\n| young | 4.5 | 0.3 |\n| old | 5.1 | 0.4 |\n| all | 4.8 | 0.5 |"),
    ("table", "id,age,weight,height\n1,34,70,172\n2,45,82,180\n3,29,64,165\n4,51,,170\n5,38,77,"),
    ("table", "organ        before     after\nliver        12.1       14.0\nkidney       3.4        3.3\nlung         9.9        8.7\nheart        5.0        5.2"),
    ("table", "\"name\";\"x\";\"y\"\n\"one\";\"1\";\"2\"\n\"two\";\"3\";\"\"\n\"three\";\"\";\"5\"\n\"four\";\"7\";\"9\""),
    ("table", "gene & fold & p \\\\\nABC & 2.1 & 0.01 \\\\\nDEF & 0.4 & 0.20 \\\\\nGHI & 1.0 & 0.90 \\\\"),
    ("table", "Table 2. Blood values by sex\nvalue,men,women\niron,20,18\nzinc,15,14\ncopper,17,19\nlead,n.d.,n.d."),
    ("junk", "a9 3f 00 1c 77 b2 e4 5d 90 aa 1e 4c 8f 02 6b d3\n11 f0 3c 9a 55 72 e8 b1 0d 4f 60 2e c7 98 3b a4"),
    ("junk", "kQ9zLmP0vB7xYt2RwE5nHs8dJf3gAuCiOqKl1ZpX6cVbNm4TyUr0WeIoPaSdFgHjKlZxCvBnMq1w2e3r4t5y6u7i8o9p0"),
    ("junk", "error error error error error error error error error error error error error error error error error"),
    ("junk", "==================================================\n=================================================="),
    ("junk", "Th{ p#ti<nts w~re g}v^n th¬ dr§g f*r tw@ w|eks. N{ne o# th<m sh~wed a ch^nge {n w¬ight, b§t p*in w@s l|ss."),
    ("junk", "x7q2 k9z0pd w3rt5 bb81n zq0 v5m2l k8 t4hj9 p0s7d r2c6 n1f3 y8u5 g4w0 h6b2"),
    ("junk", "ACGTTAGCATCGATCGGATTACAGGCATCGATTTAGC\nGGCATTACGATCGATTACGGATCGATCTTAGGCATCA\nTTAGCGATCGATTACGGCATCTAGCTAGGATCGATTA"),
    ("junk", "ÐŸÑ€ÐµÐ¿Ð°Ñ€Ð°Ñ‚ ÑÐ½Ð¸Ð¶Ð°Ð» Ð²Ð¾ÑÐ¿Ð°Ð»ÐµÐ½Ð¸Ðµ Ð² Ð¿ÐµÑ‡ÐµÐ½Ð¸ Ñƒ ÐºÑ€Ñ‹Ñ"),
]

_SUBJECTS = ["The drug", "A second dose", "The control group", "Loss of the gene", "The left kidney", "Each patient", "The new assay"]
_VERBS = ["was given to", "had no effect on", "raised the level of", "was compared with", "slowed the growth of", "did not change"]
_OBJECTS = ["the rats in the first week", "the volunteers, as expected", "all samples from the clinic", "blood flow in the liver", "the cells under low oxygen"]
_NAMES = ["renal failure", "gastritis", "atenolol", "QT-4", "asthma type 2", "lisinopril", "acute anemia", "HGF2", "colitis", "beta-carotene", "retinal injury", "PXR-11"]
_FOREIGN = ["Воспаление в печени у крыс не снижалось после отмены.", "Почему он не изменился после второй дозы?", "Пациенты получали по 4 мг в сутки.",
            "La douleur est restée stable à 3 mg, d'après l'équipe.", "Pourquoi a-t-elle été arrêtée ?", "Die Entzündung stieg für drei Tage an.",
            "La inflamación no cambió según el último análisis.", "患者每天服药一次，持续四周。", "薬を止めると症状は戻った。"]


def synthetic(per_kind: int = 140, seed: int = 5) -> list[tuple[str, str]]:
    """Rule-made examples of every kind, the same at every call."""
    r = random.Random(seed)
    out = []
    for _ in range(per_kind):
        sents = [f"{r.choice(_SUBJECTS)} {r.choice(_VERBS)} {r.choice(_OBJECTS)}." for _ in range(r.randint(2, 14))]
        text = " ".join(sents)
        if r.random() < 0.4:
            width = r.randint(50, 80)
            words, line, lines = text.split(), "", []
            for w in words:
                if len(line) + len(w) > width:
                    lines.append(line)
                    line = ""
                line += (" " if line else "") + w
            text = "\n".join([*lines, line])
        out.append(("prose", text))
        names = [r.choice(_NAMES) for _ in range(r.randint(8, 40))]
        mark = r.choice(["- {}", "* {}", "{n}. {}", "{}", "[{n}] {}", "{}; ", "{}, ", "{n}) {}, 5 mg"])
        rows = [mark.format(x, n=i + 1) for i, x in enumerate(names)]
        out.append(("list", ("Keywords: " if mark.startswith("{};") else "") + ("" if mark[-1] == " " else "\n").join(rows)))
        cols = r.randint(3, 6)
        cell = lambda: r.choice([str(r.randint(1, 400)), f"{r.random() * 10:.2f}", "n.d.", "", r.choice(["QT-4", "HGF2"])])
        grid = [["compound", "mean", "sd", "n", "dose", "p"][:cols]] + [[r.choice(_NAMES).split()[0]] + [cell() for _ in range(cols - 1)] for _ in range(r.randint(6, 30))]
        style = r.randrange(6)
        out.append(("table", "\n".join(
            "| " + " | ".join(g) + " |" if style == 0 else "\t".join(g) if style == 1 else ",".join(g) if style == 2 else
            " & ".join(g) + " \\\\" if style == 3 else ";".join(f'"{x}"' for x in g) if style == 4 else "".join(x.ljust(18) for x in g) for g in grid)))
        style = r.randrange(7)
        n = r.randint(150, 900)
        if style == 0:
            junk = " ".join(f"{r.randrange(256):02x}" for _ in range(n // 3))
        elif style == 1:
            junk = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
            if r.random() < 0.3:
                junk = "\n".join(junk[i:i + 76] for i in range(0, n, 76))
        elif style == 2:
            junk = r.choice(["null ", "page\n", "undefined ", "n/a\n", "_ ", "-", "=", ". ", "* "]) * (n // 4)
        elif style == 3:
            junk = "".join(r.choice("{}<>|~^@§¬#%*&!01I") if c.isalpha() and r.random() < 0.3 else c for c in " ".join(sents * 2))
        elif style == 4:
            junk = " ".join("".join(r.choice("bcdfghjklmnpqrstvwxz0123456789") for _ in range(r.randint(1, 11))) for _ in range(n // 6))
        elif style == 5:
            line = r.choice([60, 70])
            seq = "".join(r.choice("ACGT") for _ in range(n))
            junk = "\n".join(seq[i:i + line] for i in range(0, n, line))
        else:
            damaged = [r.choice(_FOREIGN) for _ in range(r.randint(3, 12))]
            junk = r.choice(["", " "]).join(damaged).encode().decode("latin-1")
        out.append(("junk", junk))
    return out
