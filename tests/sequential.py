"""Sequential oracles: plain Python loops applying requests one at a time over
global state, the way the order system's procedures and triggers do.

They know nothing of species folds or joins, so agreeing with the Spark jobs
checks the set-wise decomposition as well as the rules.
"""

from __future__ import annotations

from hortus.functions import codes


def replay_line_changes(stock, orders, lines, changes, finalizations=()):
    """stock: {species: qty}; orders: {id: [owner, status]}; lines: {(order, species): qty};
    changes / finalizations: dicts with ts, seq, ...  Returns (outcomes, stock, lines, emptied).

    outcomes: {(ts, seq): (esito, code, stock_after)}.
    """
    stock = dict(stock)
    orders = {k: list(v) for k, v in orders.items()}
    lines = dict(lines)
    events = [(r["ts"], r["seq"], 0, r) for r in finalizations] + [(r["ts"], r["seq"], 1, r) for r in changes]
    events.sort(key=lambda e: (e[0], e[1], e[2]))
    out = {}
    removed_from = set()
    for _, _, kind, r in events:
        o = orders.get(r["ordine"])
        owner_ok = o is not None and o[0] == r["cliente"]
        if kind == 0:
            if owner_ok:
                o[1] = 0
            continue
        sp, key, q, op = r["specie_di_pianta"], (r["ordine"], r["specie_di_pianta"]), r["quantita"], r["op"]
        code, noop = None, False
        st = stock.get(sp)
        if op not in ("ADD", "CHANGE", "REMOVE"):
            code = codes.INVALID
        elif not owner_ok:
            code = codes.NOT_OWNER
        elif op != "REMOVE" and (q is None or q < 0):
            code = codes.INVALID
        elif op == "ADD":
            if st is not None and q > st:
                code = codes.ABOVE_STOCK
            elif o[1] == 0:
                code = codes.ORDER_FINALIZED
            elif key in lines:
                code = codes.ALREADY_IN_ORDER
            elif st is None:
                code = codes.UNKNOWN_SPECIES
            else:
                lines[key] = q
                stock[sp] = st - q
        elif op == "CHANGE":
            if key not in lines:
                noop = True
            elif q - lines[key] > st:
                code = codes.ABOVE_STOCK
            elif o[1] == 0:
                code = codes.ORDER_FINALIZED
            else:
                stock[sp] = st - (q - lines[key])
                lines[key] = q
        else:
            if key not in lines:
                noop = True
            elif o[1] == 0:
                code = codes.ORDER_FINALIZED
            else:
                stock[sp] = st + lines.pop(key)
                removed_from.add(r["ordine"])
        esito = codes.REJECTED if code else (codes.NOOP if noop else codes.ACCEPTED)
        out[(r["ts"], r["seq"])] = (esito, code, stock.get(sp))
    still = {k[0] for k in lines}
    emptied = {o for o in removed_from if o not in still}
    return out, stock, lines, emptied


def replay_new_orders(stock, customers, contact_owner, requests, max_id):
    """customers: {code: (residence, preferred)}; contact_owner: {contact: set(owner codes)}.
    Returns ({(ts, seq): (esito, code, new_id)}, stock)."""
    stock = dict(stock)
    out = {}
    next_id = max_id
    for r in sorted(requests, key=lambda x: (x["ts"], x["seq"])):
        cust = customers.get(r["cliente"])
        contact = r["contatto"]
        code = None
        if contact is None:
            if cust is None or cust[1] is None:
                code = codes.NO_PREFERRED_CONTACT
        elif r["cliente"] not in contact_owner.get(contact, set()):
            code = codes.CONTACT_NOT_OWNED
        if code is None and (r["quantita"] is None or r["quantita"] < 0):
            code = codes.INVALID
        sp, q = r["specie_di_pianta"], r["quantita"]
        if code is None:
            st = stock.get(sp)
            if st is not None and q > st:
                code = codes.ABOVE_STOCK
            elif st is None:
                code = codes.UNKNOWN_SPECIES
            else:
                stock[sp] = st - q
        new_id = None
        if code is None:
            next_id += 1
            new_id = next_id
        out[(r["ts"], r["seq"])] = (codes.REJECTED if code else codes.ACCEPTED, code, new_id)
    return out, stock


def replay_packs(orders_status, ordered, packed, packs, contents, requests):
    """orders_status: {order: status}; ordered: {(order, species): qty}; packed: {(order, species): qty};
    packs: {order: set(numbers)}; contents: set((order, pack, species)).
    Returns ({(ts, seq): (esito, code, pack_number)}, contents_added {(order, pack, species): qty})."""
    packed = dict(packed)
    snapshot_packs = {k: set(v) for k, v in packs.items()}
    packs = {k: set(v) for k, v in packs.items()}
    contents = set(contents)
    handles = {}
    failed = set()
    out = {}
    added = {}
    for r in sorted(requests, key=lambda x: (x["ts"], x["seq"])):
        o, sp, q = r["ordine"], r["specie_di_pianta"], r["quantita"]
        code = None
        number = None
        creating = False
        if r["new_pack"] is not None:
            h = (o, r["new_pack"])
            if h in handles:
                number = handles[h]
            elif h not in failed:
                creating = True
        else:
            number = r["pacco"]
        if q is None or q < 0:
            code = codes.INVALID
        elif creating:
            status = orders_status.get(o)
            if status == 1:
                code = codes.ORDER_OPEN
            elif status is None:
                code = codes.UNKNOWN_PACK_ORDER
        if code is None:
            if (o, sp) not in ordered:
                code = codes.NOT_IN_ORDER
            elif q > ordered[(o, sp)] - packed.get((o, sp), 0):
                code = codes.ABOVE_REMAINDER
            elif not creating and (number is None
                                   or (r["new_pack"] is None and number not in snapshot_packs.get(o, set()))):
                code = codes.UNKNOWN_PACK
            elif not creating and (o, number, sp) in contents:
                code = codes.DUPLICATE
        if code is not None and creating:
            failed.add((o, r["new_pack"]))
        if code is None:
            if creating:
                number = max(packs.get(o, set()) | {0}) + 1
                packs.setdefault(o, set()).add(number)
                handles[(o, r["new_pack"])] = number
            contents.add((o, number, sp))
            added[(o, number, sp)] = q
            packed[(o, sp)] = packed.get((o, sp), 0) + q
        out[(r["ts"], r["seq"])] = (codes.REJECTED if code else codes.ACCEPTED, code, number if code is None else None)
    return out, added
