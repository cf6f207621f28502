"""DataFrame operators over pixels, patches and peaks."""
