"""A one-record-at-a-time resolver over plain dicts, to check the layer against."""

from __future__ import annotations

import unicodedata

GENERIC = {"gmail.com", "hotmail.com", "outlook.com", "yahoo.com.br", "yahoo.com", "uol.com.br", "bol.com.br"}


def domain(mail):
    d = (mail or "").partition("@")[2]
    return "" if d in GENERIC else d


def grams(s):
    t = f" {s.replace(' ', '')} "
    return [t[i : i + 2] for i in range(len(t) - 1)]


def similarity(a, b):
    if not a or not b:
        return 0.0
    ga, gb = grams(a), grams(b)
    dice = 1.0 if a == b else 2 * sum(min(ga.count(g), gb.count(g)) for g in set(ga)) / (len(ga) + len(gb))
    ta, tb = set(a.split(" ")), set(b.split(" "))
    return max(dice, len(ta & tb) / len(ta | tb))


def upper(s):
    return "".join(c for c in unicodedata.normalize("NFD", s) if not 0x300 <= ord(c) <= 0x36F).upper()


class Resolver:
    def __init__(self, rows, p):
        self.p, self.rows = p, sorted(rows, key=lambda r: r["pos"])
        self.cad = [r for r in self.rows if r["papel"] == "cadastro"]
        self.parent = {r["ref"]: r["ref"] for r in self.cad}
        self.ids = {r["ref"]: {r["cnpj"]} if r["cnpjOk"] else set() for r in self.cad}
        self.merged, self.refused, self.fixed = [], [], {}
        self.resolve()
        self.assemble()
        self.link()

    def find(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        x, y = self.find(a["ref"]), self.find(b["ref"])
        if x == y:
            return
        if self.ids[x] and self.ids[y] and not self.ids[x] & self.ids[y]:
            self.refused.append((a["ref"], b["ref"]))
            return
        self.parent[y] = x
        self.ids[x] |= self.ids[y]
        self.merged.append((a["ref"], b["ref"]))

    def resolve(self):
        p, first = self.p, {}
        for r in self.cad:
            if r["cnpjOk"]:
                if r["cnpj"] in first:
                    self.join(first[r["cnpj"]], r)
                else:
                    first[r["cnpj"]] = r
        for r in self.cad:
            if len(r["cnpj"] or "") == 14 and not r["cnpjOk"]:
                near = [c for c in first if sum(x != y for x, y in zip(c, r["cnpj"], strict=True)) == 1]
                ok = [c for c in near if similarity(first[c]["nome"], r["nome"]) >= p.simCorrecaoCnpj or any(o["cnpj"] == c and o["fone"] and o["fone"] == r["fone"] for o in self.cad)]
                if len(ok) == 1:
                    self.fixed[r["ref"]] = ok[0]
                    self.join(first[ok[0]], r)

        def keyed(key, guard, city=False, every=False):
            blocks = {}
            for r in self.cad:
                if k := key(r):
                    blocks.setdefault(k, []).append(r)
            for block in blocks.values():
                for i, r in enumerate(block):
                    for o in block[:i]:
                        if similarity(r["nome"], o["nome"]) >= guard and (not city or (r["cidade"] and r["cidade"] == o["cidade"])):
                            self.join(o, r)
                            if not every:
                                break

        group = p.grupo != "atual"
        keyed(lambda r: r["email"], 0, group)
        keyed(lambda r: r["fone"] if r["fone"] and len(r["fone"]) == 8 else "", p.guardaFone)
        if p.grupo != "pendente":
            keyed(lambda r: domain(r["email"]), p.guardaDominio, group)
        keyed(lambda r: f"{r['end']['chave']}|{r['end']['cidade']}" if r["end"] and r["end"]["chave"] else "", p.guardaEnd)
        keyed(lambda r: r["cidade"] or "?", p.quaseIdentico, every=True)

    def assemble(self):
        clusters = {}
        for r in self.cad:
            clusters.setdefault(self.find(r["ref"]), []).append(r)
        self.of, self.ents = {}, []
        for n, regs in enumerate(clusters.values(), 1):
            e = {"id": f"ENT-{n:04d}", "names": list(dict.fromkeys(r["nome"] for r in regs if r["nome"])), "mails": list(dict.fromkeys(r["email"] for r in regs if r["email"])), "phones": [r["fone"] for r in regs if r["fone"]], "ids": list(dict.fromkeys(filter(None, (r["cnpj"] if r["cnpjOk"] else self.fixed.get(r["ref"]) for r in regs)))), "regs": regs}
            self.ents.append(e)
            for r in regs:
                self.of[r["ref"]] = e
        self.by = {e["id"]: e for e in self.ents}
        for e in self.ents:
            roots = {c[:8] for c in e["ids"]}
            e["group"] = [o["id"] for o in self.ents if o is not e and roots & {c[:8] for c in o["ids"]}]

    def best(self, name, ents):
        return sorted(((max([0.0, *(similarity(n, name) for n in e["names"])]), e) for e in ents), key=lambda x: -x[0])

    def link(self):
        p = self.p
        mail, phone, dom, people = {}, {}, {}, {}
        for e in self.ents:
            for m in e["mails"]:
                mail.setdefault(m, []).append(e)
            for f in e["phones"]:
                phone[f] = e
            for d in dict.fromkeys(filter(None, map(domain, e["mails"]))):
                dom.setdefault(d, []).append(e)
        for r in self.cad:
            if r["contato"]:
                own = people.setdefault(upper(r["contato"]), [])
                if self.of[r["ref"]] not in own:
                    own.append(self.of[r["ref"]])
        votes = {}
        said = [r for r in self.rows if r["papel"] == "mencao"]
        if p.grupo == "aprende":
            for r in said:
                if r["email"] and r["nome"]:
                    via = mail.get(r["email"]) or dom.get(domain(r["email"]), [])
                    g = next((e for e in via if e["group"]), None)
                    if g:
                        sc = self.best(r["nome"], [g, *(self.by[i] for i in g["group"])])
                        if sc[0][0] - sc[1][0] >= p.margem:
                            votes.setdefault(r["email"], set()).add(sc[0][1]["id"])
        self.links, self.pending = {}, {}
        for final in (False, True):
            for r in said:
                if r["ref"] in self.links:
                    continue
                got = self.decide(r, final, mail, phone, dom, people, votes)
                if got is None:
                    continue
                if isinstance(got, list):
                    self.pending[r["ref"]] = [e["id"] for e in got]
                    continue
                e, why = got
                self.links[r["ref"]] = (e["id"], why)
                if p.aprendeEmail and r["email"] and "nome parecido" not in why and "contato conhecido" not in why:
                    own = mail.setdefault(r["email"], [])
                    if e not in own:
                        own.append(e)

    def decide(self, r, final, mail, phone, dom, people, votes):
        p, e, why = self.p, None, ""
        via = mail.get(r["email"], []) if r["email"] else []
        d = domain(r["email"])
        person = upper(r["pessoa"]) if r["pessoa"] else None
        if len(via) == 1:
            e, why = via[0], "e-mail do remetente já conhecido"
        elif r["fone"] and r["fone"] in phone:
            e, why = phone[r["fone"]], "telefone da assinatura"
        elif len(via) > 1:
            sc = self.best(r["nome"], via)
            if sc[0][0] - sc[1][0] >= p.margem:
                e, why = sc[0][1], "e-mail compartilhado no grupo + nome"
            else:
                return list(via) if final else None
        elif d and d in dom:
            if len(dom[d]) == 1:
                e, why = dom[d][0], "domínio corporativo do remetente"
            else:
                sc = self.best(r["nome"], dom[d])
                if sc[0][0] - sc[1][0] >= p.margem:
                    e, why = sc[0][1], "domínio de grupo + nome"
                elif final:
                    return list(dom[d])
        elif person in people:
            sc = self.best(r["nome"], people[person])
            if sc[0][0] >= p.limiarContato and (len(sc) < 2 or sc[0][0] - sc[1][0] >= p.margem):
                e, why = sc[0][1], "contato conhecido no CRM + nome da empresa"
        if e is None and r["nome"] and final:
            words = set(r["nome"].split(" "))
            fit = [x for x in self.ents if any(words <= set(n.split(" ")) for n in x["names"])]
            if p.regraIncompleto and len(fit) > 1 and not any(r["nome"] in x["names"] for x in fit):
                return fit[:4]
            sc = self.best(r["nome"], self.ents)
            if sc[0][0] >= p.limiarMencaoNome and sc[0][0] - (sc[1][0] if len(sc) > 1 else 0) >= p.margem:
                e, why = sc[0][1], f"nome parecido ({sc[0][0]:.2f})"
            else:
                return [x for s, x in sc[:3] if s >= 0.5]
        if e is not None and p.grupo != "atual" and e["group"] and why != "telefone da assinatura":
            units = [e, *(self.by[i] for i in e["group"])]
            sc = self.best(r["nome"], units)
            if p.grupo != "pendente" and sc[0][0] - sc[1][0] >= p.margem:
                return sc[0][1], why + " + nome que separa a unidade do grupo"
            if p.grupo == "aprende" and why == "e-mail do remetente já conhecido" and len(votes.get(r["email"], ())) <= 1:
                return e, why + " (e-mail nunca usado por outra unidade do grupo)"
            return units if final else None
        return None if e is None else (e, why)
