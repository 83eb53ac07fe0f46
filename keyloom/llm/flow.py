"""Minimum-cost flow on graphs of shards (never of rows)."""

from __future__ import annotations

import heapq


def solve(n: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """The flow on each of arcs (from, to, capacity, cost at least 0) of a cheapest maximum flow.

    Primal-dual: shortest distances make node prices, then all paths of that length are
    filled at once, so the rounds are as many as there are path lengths.
    """
    out: list[list[int]] = [[] for _ in range(n)]
    head, left, cost = [], [], []
    for u, v, c, w in arcs:
        for a, b, room, price in ((u, v, c, w), (v, u, 0, -w)):
            out[a].append(len(head))
            head.append(b)
            left.append(room)
            cost.append(price)
    price = [0] * n
    while True:
        dist: list[float] = [float("inf")] * n
        dist[source], queue = 0, [(0, source)]
        while queue:
            d, u = heapq.heappop(queue)
            if d > dist[u]:
                continue
            for e in out[u]:
                x = d + cost[e] + price[u] - price[head[e]]
                if left[e] and x < dist[head[e]]:
                    dist[head[e]] = x
                    heapq.heappush(queue, (x, head[e]))
        if dist[sink] == float("inf"):
            return [left[2 * k + 1] for k in range(len(arcs))]
        most = max(d for d in dist if d < float("inf"))
        price = [int(p + min(d, most)) for p, d in zip(price, dist, strict=True)]
        tight = lambda u, e: left[e] and cost[e] + price[u] == price[head[e]]  # noqa: E731, B023
        while True:
            level = [-1] * n
            level[source], queue = 0, [source]
            for u in queue:
                for e in out[u]:
                    if tight(u, e) and level[head[e]] < 0:
                        level[head[e]] = level[u] + 1
                        queue.append(head[e])
            if level[sink] < 0:
                break
            at, path, u = [0] * n, [], source
            while True:
                if u == sink:
                    amount = min(left[e] for e in path)
                    for e in path:
                        left[e] -= amount
                        left[e ^ 1] += amount
                    path, u = [], source
                    continue
                while at[u] < len(out[u]):
                    e = out[u][at[u]]
                    if tight(u, e) and level[head[e]] == level[u] + 1:
                        break
                    at[u] += 1
                if at[u] < len(out[u]):
                    path.append(out[u][at[u]])
                    u = head[path[-1]]
                elif path:
                    u = head[path.pop() ^ 1]
                    at[u] += 1
                else:
                    break


def min_cost_flow(supply: list[int], demand: list[int], cost) -> dict[tuple[int, int], int]:
    """The cheapest flow {(i, j): amount} that moves all supply into the demand.

    cost(i, j) is the price of a unit, at least 0; there is an arc for each pair.
    """
    if sum(supply) != sum(demand):
        raise ValueError("supply and demand differ")
    n, m = len(supply), len(demand)
    pairs = [(i, j) for i in range(n) for j in range(m)]
    arcs = [(i, n + j, supply[i], cost(i, j)) for i, j in pairs]
    arcs += [(n + m, i, s, 0) for i, s in enumerate(supply)] + [(n + j, n + m + 1, d, 0) for j, d in enumerate(demand)]
    return {k: x for k, x in zip(pairs, solve(n + m + 2, arcs, n + m, n + m + 1)) if x}


def transfers(supply: list[int], demand: list[int]) -> dict[tuple[int, int], int]:
    """min_cost_flow() where a unit costs 0 if it stays (i = j) and 1 otherwise.

    All moves pass through one further node, so the graph has three arcs a shard.
    """
    if sum(supply) != sum(demand):
        raise ValueError("supply and demand differ")
    n, m = len(supply), len(demand)
    hub, s, t = n + m, n + m + 1, n + m + 2
    stay = list(range(min(n, m)))
    arcs = [(i, n + i, supply[i], 0) for i in stay] + [(i, hub, x, 1) for i, x in enumerate(supply)] + [(hub, n + j, d, 0) for j, d in enumerate(demand)]
    flow = solve(n + m + 3, arcs + [(s, i, x, 0) for i, x in enumerate(supply)] + [(n + j, t, d, 0) for j, d in enumerate(demand)], s, t)
    out = {(i, i): flow[k] for k, i in enumerate(stay) if flow[k]}
    leave = [[i, x] for i, x in enumerate(flow[len(stay) : len(stay) + n]) if x]
    for j, x in enumerate(flow[len(stay) + n : len(stay) + n + m]):
        while x:
            amount = min(x, leave[-1][1])
            out[leave[-1][0], j] = out.get((leave[-1][0], j), 0) + amount
            x, leave[-1][1] = x - amount, leave[-1][1] - amount
            if not leave[-1][1]:
                leave.pop()
    return out
