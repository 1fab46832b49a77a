"""What the exchanges of a plan carry."""


def shuffled(df):
    """Types of all columns that any shuffle of the plan moves."""
    kinds, stack = set(), [df._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            stack.append(node.initialPlan())
            continue
        if name == "ShuffleExchangeExec":
            columns = node.output().iterator()
            while columns.hasNext():
                kinds.add(columns.next().dataType().simpleString())
        children = node.children().iterator()
        while children.hasNext():
            stack.append(children.next())
    return kinds
