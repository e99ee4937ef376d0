"""DataFrame operators shared by the feature plans."""
