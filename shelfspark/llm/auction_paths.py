"""Cheapest edits of a run of messages by an auction for shortest paths.

A run of n messages is a lattice of nodes (messages read, state of the wanted pattern) with the arcs
Delete, Insert, Keep and Rerole. The auction keeps one path from the entry and a price for every node, where
no price exceeds the cost of an arc plus the price of its end. At the last node of the path, either an arc
costs exactly the difference of prices, then the path is extended by it, or the price is raised until
one does and the path is contracted by a node. When the path reaches the end, the prices are an optimal dual:
every arc of every cheapest path is tight (price = cost + price of its end). Tight arcs from which the end
can be reached by tight arcs are traced with the smallest label first, so ties go to the ASCII-least edits.

Pattern of role initials: ``(s?(ua)+)?``. States: 0 nothing yet, 1 after s, 2 after u, 3 after a.
"""

from __future__ import annotations

STATES = 4
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
# State after each kept initial, and the state and role that a user or assistant message leads to.
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
NEXT = (2, 2, 3, 2)
ROLE = ("user", "user", "assistant", "user")
NEVER = 1 << 40
# Costs at the end of a conversation.
ACCEPTED = [0, NEVER, NEVER, 0]

Arc = tuple[str, int, int]


def lattice(codes: str, final: bool) -> list[list[Arc]]:
    """Arcs (label, cost, end) of each node, in the order of labels. Node = 4 * messages read + state.

    One code per message: its role initial (x for any other), in upper case if it is cut short, and - if it
    must go. Insertions behind the last message belong to this run only if it is the ``final`` one.
    """
    arcs: list[list[Arc]] = []
    for i, code in enumerate(codes + "$"):
        extra = CUT if code.isupper() else 0
        kept = KEPT.get(code.lower(), (None,) * STATES)
        for state in range(STATES):
            node = STATES * i + state
            here: list[Arc] = []
            if code != "$":
                here.append(("D", DELETE, node + STATES))
            if code != "$" or final:
                here.append(("I", INSERT, STATES * i + NEXT[state]))
            if code not in "$-":
                if kept[state] is not None:
                    here.append(("K", extra, STATES * (i + 1) + kept[state]))
                here.append(("R", REROLE + extra, STATES * (i + 1) + NEXT[state]))
            arcs.append(here)
    return arcs


def first_prices(codes: str, tails: list[int]) -> list[int]:
    """Prices that no arc undercuts: what the messages that follow cost at least, in any state."""
    least, prices = min(tails), []
    for code in reversed(codes):
        prices.append(least)
        least += DELETE if code == "-" else (CUT if code.isupper() else 0) + (REROLE if code.lower() == "x" else 0)
    prices.append(least)
    return [p for p in reversed(prices) for _ in range(STATES)]


def end_reached(arcs: list[list[Arc]], ends: list[bool], usable) -> list[bool]:
    """Nodes from which an end can be reached by ``usable(node, arc)`` arcs."""
    reached = list(ends)
    for first in range(len(arcs) - STATES, -1, -STATES):
        # Insertions stay among the messages read: two of them lead to any state that they can lead to.
        for _ in range(STATES):
            for node in range(first, first + STATES):
                reached[node] = reached[node] or any(reached[arc[2]] and usable(node, arc) for arc in arcs[node])
    return reached


def auction(codes: str, entry: int, tails: list[int], final: bool = True) -> tuple[int, int, str] | None:
    """Cost, exit state and labels of the cheapest, then ASCII-least path from state ``entry`` of a run.

    ``tails`` is the cost behind each exit state, which the cost includes. None if no exit can be reached.
    """
    arcs = lattice(codes, final)
    last = STATES * len(codes)
    exits = [False] * last + [t < NEVER for t in tails]
    alive = end_reached(arcs, exits, lambda node, arc: True)
    if not alive[entry]:
        return None
    arcs = [[arc for arc in here if alive[arc[2]]] for here in arcs]
    end = len(arcs)
    for state in range(STATES):
        if tails[state] < NEVER:
            # The end comes before all labels: nothing that follows is as short.
            arcs[last + state].insert(0, ("", tails[state], end))
    prices = first_prices(codes, tails) + [0]
    path = [entry]
    while path[-1] != end:
        node = path[-1]
        best, to = NEVER * 2, end
        for _, cost, after in arcs[node]:
            if cost + prices[after] < best:
                best, to = cost + prices[after], after
        if prices[node] < best:
            prices[node] = best
            if len(path) > 1:
                path.pop()
        else:
            path.append(to)
    tight = lambda node, arc: prices[node] == arc[1] + prices[arc[2]]
    leads = end_reached([[arc for arc in here if arc[2] != end] for here in arcs],
                        [any(arc[2] == end and tight(node, arc) for arc in here) for node, here in enumerate(arcs)], tight)
    node, labels = entry, []
    while True:
        label, _, after = next(arc for arc in arcs[node] if (arc[2] == end or leads[arc[2]]) and tight(node, arc))
        if after == end:
            return prices[entry], node - last, "".join(labels)
        labels.append(label)
        node = after


def transfer(codes: str, final: bool) -> list[int]:
    """Least cost from each entry to each exit state of a run, row by row."""
    out = []
    for entry in range(STATES):
        for leave in range(STATES):
            found = auction(codes, entry, [0 if q == leave else NEVER for q in range(STATES)], final)
            out.append(NEVER if found is None else found[0])
    return out


def placed(labels: str, entry: int, codes: str) -> tuple[list[str], list[str | None], str]:
    """What the labels do to the messages of a run.

    Initials of messages inserted before each; for each the new role, "" if it stays, null if it goes;
    initials inserted at the end.
    """
    state, before, roles, waiting = entry, [], [], ""
    for label in labels:
        if label == "I":
            waiting += ROLE[state][0]
            state = NEXT[state]
            continue
        code = codes[len(roles)].lower()
        before.append(waiting)
        roles.append({"D": None, "K": "", "R": ROLE[state]}[label])
        waiting = ""
        if label == "K":
            state = KEPT[code][state]
        elif label == "R":
            state = NEXT[state]
    return before, roles, waiting
